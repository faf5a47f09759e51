"""Tables of lookup requests answered by equi-joins.

Requests are normalised and counted first, so a URI asked a million times is answered once; answers
are keyed by ``uri`` and carry ``n_requests``. Each URI gets one kind (the first pattern that fits)
and one key; catalogue rows list the keys under which they can be found, and both meet on
(kind, key). User text is literal: no sign in it acts as a wildcard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashelf.functions.text import split_uri, vat_key
from terrashelf.operators.prefix import containing, containing_indexed, lengths_of, prefix_lengths, store_piece_index
from terrashelf.plans.catalogue import JURISDICTION_BYTES, star
from terrashelf.session import BROADCAST_BYTES, cut, hinted

NUMBER = r"^\d+\z"


def split_requests(requests: DataFrame, prefix: list[str] | None = None) -> DataFrame:
    """Requests with ``parts``, the path after the prefix; null where the prefix does not match."""
    return requests.withColumn("parts", split_uri(F.col("uri"), prefix))


def _distinct(requests: DataFrame) -> DataFrame:
    """Distinct normalised URIs with their number of requests, first and second path part."""
    parts = split_uri(F.col("uri"))
    return (
        requests.where(F.col("uri").isNotNull())
        .groupBy(
            F.array_join(parts, "/").alias("uri"),
            F.get(parts, F.lit(0)).alias("p1"),
            F.get(parts, F.lit(1)).alias("p2"),
        )
        .agg(F.count(F.lit(1)).alias("n_requests"))
    )


def _beyond(n: int) -> Column:
    """The first path part without its first ``n`` signs."""
    return F.substr("p1", F.lit(n + 1))


def _worded(word: str, kind: str, key=lambda rest: rest) -> tuple[Column, str, Column]:
    """The rule for a part that begins with ``word``; its key comes from what follows, which must not be empty."""
    return F.col("p1").startswith(word) & (F.length("p1") > len(word)), kind, key(_beyond(len(word)))


def _number(text: Column) -> Column:
    return text.try_cast("long")


#: Signs of a country and state in front of a code or name, as in ``br-xx-``, with the sign that ends it.
STATE_HEAD = len("br-xx-")


def _classed(requests: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """Add ``kind`` and ``key`` by the first rule whose condition holds.

    Written once: every kind reads the classed requests again, and their size is then known.
    """
    found = None
    for condition, kind, key in rules:
        value = F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
        found = F.when(condition, value) if found is None else found.when(condition, value)
    return cut(_distinct(requests).withColumn("_found", found)).select(
        "uri", "n_requests", "p1", "p2", "_found.kind", "_found.key"
    )


def _beginnings(kind: str, text: Column, lengths: Column) -> Column:
    """Entries for the beginnings of ``text`` of the given lengths; none for a null text."""
    cuts = F.coalesce(prefix_lengths(text, lengths), F.array().cast("array<int>"))
    return F.transform(
        cuts, lambda n: F.struct(F.lit(kind).alias("kind"), F.substring(text, F.lit(1), n).alias("key"))
    )


def _joined(asked: DataFrame, rows: DataFrame, keys: list[tuple[str, Column]], heads: dict[str, Column]) -> DataFrame:
    """Match on (kind, key). ``heads`` are starts-with kinds: a row lists its text's beginnings, but
    only of lengths that some request of the kind has."""
    listed = rows
    arrays = [F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys])]
    for kind, text in heads.items():
        lengths = lengths_of(asked.where(F.col("kind") == kind), "key")
        listed = listed.withColumn(f"_n_{kind}", lengths)
        arrays.append(_beginnings(kind, text, F.col(f"_n_{kind}")))
    listed = listed.withColumn("_entry", F.explode(F.concat(*arrays))).select(
        *rows.columns, F.col("_entry.kind").alias("kind"), F.col("_entry.key").alias("key")
    ).where("key IS NOT NULL")
    wanted = asked.where("kind IS NOT NULL AND key IS NOT NULL").select("uri", "n_requests", "kind", "key")
    return listed.join(hinted(wanted), ["kind", "key"]).select("uri", "n_requests", "kind", *rows.columns)


def _everything(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole table under the empty URI, if it was asked for at all."""
    times = asked.where(F.col("kind") == "all").agg(F.sum("n_requests")).scalar()
    return rows.select(F.lit("").alias("uri"), times.alias("n_requests"), F.lit("all").alias("kind"), *rows.columns).where(
        "n_requests IS NOT NULL"
    )


def jurisdictions(requests: DataFrame, jurisdiction: DataFrame) -> DataFrame:
    """Jurisdictions by label, label beginning, parent, state code, name, wikidata, OSM or local id."""
    two_numbers = F.col("p2").rlike(NUMBER)
    asked = _classed(requests, [
        (F.col("p1") == "", "all", F.lit("")),
        _worded("isolabel_ext.lk.", "label_head", F.upper),
        _worded("parent_abbrev.lk.", "label_and_parent", F.upper),
        _worded("parent_abbrev.eq.", "parent", F.upper),
        (F.col("p1").rlike(r"(?s)^br-..-...\z"), "state_abbrev",
         F.upper(F.concat(F.substring("p1", 1, STATE_HEAD), F.lit("|"), _beyond(STATE_HEAD)))),
        (F.col("p1").rlike(r"(?s)^br;..;.*\z"), "state_name",
         F.concat(F.replace(F.upper(F.substring("p1", 1, STATE_HEAD)), F.lit(";"), F.lit("-")), F.lit("|"), _beyond(STATE_HEAD))),
        (F.col("p1").rlike(r"^q\d+\z"), "wikidata", _number(_beyond(len("q")))),
        (F.col("p1").rlike(NUMBER) & F.col("p2").isNull(), "osm", F.col("p1").try_cast("long")),
        (F.col("p1").rlike(NUMBER), "base_local",
         F.when(two_numbers, F.concat_ws("/", F.col("p1").try_cast("int"), F.col("p2").try_cast("int")))),
        (F.col("p2").isNull(), "label", F.upper("p1")),
        (two_numbers, "label_local", F.upper("p1")),
    ])
    # Label plus local id: the label's country id first, then like base_local.
    bases = jurisdiction.select(F.col("isolabel_ext").alias("key"), "jurisd_base_id")
    by_country = asked.where(F.col("kind") == "label_local").join(bases, "key").select(
        "uri", "n_requests", "p1", "p2", "kind",
        F.concat_ws("/", "jurisd_base_id", F.col("p2").try_cast("int")).alias("key"),
    )
    asked = asked.where("kind <> 'label_local'").unionByName(by_country)
    label, head = F.upper("isolabel_ext"), F.substring("isolabel_ext", 1, STATE_HEAD)
    local = F.concat_ws("/", "jurisd_base_id", "jurisd_local_id")
    keys = [
        ("label_and_parent", F.when(F.startswith("isolabel_ext", "parent_abbrev"), F.col("parent_abbrev"))),
        ("parent", F.col("parent_abbrev")),
        ("state_abbrev", F.concat(head, F.lit("|"), F.col("abbrev"))),
        ("state_name", F.concat(head, F.lit("|"), F.col("lexlabel"))),
        ("wikidata", F.col("wikidata_id")),
        ("osm", F.col("osm_id")),
        ("base_local", local),
        ("label_local", local),
        ("label", label),
    ]
    return _joined(asked, jurisdiction, keys, {"label_head": label}).unionByName(_everything(asked, jurisdiction))


# Texts of a donor that are searched for a part, and how they are compared.
DONOR_TEXTS = {"legalname_part": "upper(legalname)", "url_part": "url"}


def store_donor_index(donor: DataFrame, path: str) -> None:
    """The index of pieces that ``donors`` takes as ``index``; built once for a version of the table."""
    store_piece_index(donor, "id", DONOR_TEXTS, path)


def donors(requests: DataFrame, donor: DataFrame, index: str | None = None) -> DataFrame:
    """Donors by id, wikidata id, VAT id, short name, or by part of scope, name, URL or short name.

    ``donor`` may carry the totals column of the catalogue; it must still have ``kx_vat_id``. ``index`` is where
    ``store_donor_index`` wrote; without it the pieces that are asked for are cut out of all names and URLs.
    """
    asked = _classed(requests, [
        (F.col("p1") == "", "all", F.lit("")),
        (F.col("p1").rlike(NUMBER), "id", F.col("p1").try_cast("long")),
        (F.col("p1").rlike(r"^q\d+\z"), "wikidata", _number(_beyond(len("q")))),
        _worded("scope.lk.", "scope_head", F.upper),
        _worded("legalname.lk.", "legalname_part", F.upper),
        _worded("url.lk.", "url_part"),
        _worded("shortname.lk.", "shortname_head", F.upper),
        (F.col("p1").rlike(r"(?s)^[a-z]+:.+\z"), "vat", vat_key(F.col("p1"))),
        (F.lit(True), "shortname", F.upper("p1")),
    ])
    keys = [
        ("id", F.col("id")),
        ("wikidata", F.col("wikidata_id")),
        ("vat", F.col("kx_vat_id")),
        ("shortname", F.col("shortname")),
    ]
    heads = {"scope_head": F.col("scope"), "shortname_head": F.col("shortname")}
    answers = _joined(asked, donor, keys, heads).unionByName(_everything(asked, donor))
    wanted = asked.where(F.col("kind").isin(*DONOR_TEXTS)).select("uri", "n_requests", "kind", "key")
    if index is not None:
        needles = wanted.select(F.col("kind").alias("field"), F.col("key").alias("needle"))
        pairs = containing_indexed(needles, index, donor, "id", DONOR_TEXTS).select(
            F.col("field").alias("kind"), F.col("needle").alias("key"), "id")
    else:
        pairs = reduce(DataFrame.unionByName, [
            containing(wanted.where(F.col("kind") == kind), "key", donor.select("id", F.expr(text).alias("_searched")), "id", "_searched")
            .select(F.lit(kind).alias("kind"), "key", "id") for kind, text in DONOR_TEXTS.items()])
    found = wanted.join(pairs, ["kind", "key"]).join(donor, "id")
    return answers.unionByName(found.select("uri", "n_requests", "kind", *donor.columns))


def _origin_requests(requests: DataFrame) -> DataFrame:
    return _classed(requests, [
        _worded("jurisd_osm_id.eq.", "jurisdiction", _number),
        _worded("jurisd_isolabel_ext.eq.", "label", F.upper),
        _worded("donor_id.eq.", "donor", _number),
        _worded("donor_shortname.eq.", "donor_shortname", F.upper),
        _worded("jurisd_state.eq.", "state", F.upper),
        (F.col("p1").rlike(NUMBER), "id", F.col("p1").try_cast("long")),
        (F.col("p1").rlike(r"^sha256:[0-9a-f]{4}"), "hash", _beyond(len("sha256:"))),
    ]).where("kind IS NOT NULL").select("uri", "n_requests", "kind", "key")


def _fact_keys(asked: DataFrame, jurisdiction: DataFrame, pack: DataFrame, donor: DataFrame) -> DataFrame:
    """Requests as keys of the fact table itself: jurisdiction, pack, id or hash beginning.

    Labels, states and donors are resolved on the small tables, so the fact table is read once and
    filtered by its own columns.
    """
    in_state = (F.substring("isolabel_ext", 3, 1) == "-") & F.startswith(
        F.expr("substr(isolabel_ext, 4)"), F.col("parent_abbrev")
    )
    places = _joined(
        asked.where("kind IN ('label', 'state')"),
        jurisdiction.select("osm_id", "isolabel_ext", "parent_abbrev"),
        [("label", F.upper("isolabel_ext")), ("state", F.when(in_state, F.col("parent_abbrev")))],
        {},
    ).select("uri", "n_requests", "kind", F.lit("jurisdiction").alias("found_by"), F.col("osm_id").cast("string").alias("key"))
    givers = _joined(
        asked.where("kind IN ('donor', 'donor_shortname')"),
        donor.select("id", "shortname"),
        [("donor", F.col("id")), ("donor_shortname", F.col("shortname"))],
        {},
    )
    packs = pack.join(givers, pack["donor_id"] == givers["id"]).select(
        "uri", "n_requests", "kind", F.lit("pack").alias("found_by"), F.col("pack_id").cast("string").alias("key")
    )
    direct = asked.where("kind IN ('jurisdiction', 'id', 'hash')").select(
        "uri", "n_requests", "kind", F.col("kind").alias("found_by"), "key"
    )
    return direct.unionByName(places).unionByName(packs)


#: The most keys that are looked up by one beginning which they share.
HEAD_KEYS = 8


def _heads(keys: DataFrame) -> DataFrame:
    """Each distinct ``key`` with its ``head``: the shortest beginning, of a length that some key has, shared by at most
    ``HEAD_KEYS`` keys; else the key itself. So rows list few beginnings, however many lengths are asked."""
    cuts = (
        keys.withColumn("_n", lengths_of(keys, "key"))
        .select("key", F.explode(prefix_lengths(F.col("key"), F.col("_n"))).alias("_n"))
        .select("key", "_n", F.expr("left(key, _n)").alias("head"))
    )
    crowded = cuts.groupBy("head").agg(F.count(F.lit(1)).alias("_keys")).where(F.col("_keys") > HEAD_KEYS)
    fits = cuts.join(crowded, "head", "left").where(F.col("_keys").isNull() | (F.col("head") == F.col("key")))
    return fits.groupBy("key").agg(F.min("_n").alias("_n")).select("key", F.expr("left(key, _n)").alias("head"))


def _hash_cuts(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """``id`` of the files with the beginnings of their hash: as ``head`` each of the lengths that the heads of ``hashes`` have,
    as ``_text`` that of the longest key."""
    longest = hashes.agg(F.max(F.length("key"))).scalar()
    rows = files.withColumns({"_n": lengths_of(hashes, "head"), "_longest": longest}).select(
        "id", F.expr("left(fhash, _longest)").alias("_text"), "_n")
    return rows.select("id", "_text", F.explode(prefix_lengths(F.col("_text"), F.col("_n"))).alias("_n")).select(
        "id", "_text", F.expr("left(_text, _n)").alias("head"))


def _origins_found(asked: DataFrame, keyed: DataFrame, origin: DataFrame) -> DataFrame:
    """Files under the keys that are asked, kind by kind, each key in the type of the column it is held against.

    Identifiers and one key of the files meet the keys of a kind: where they lie if those are few, else by shuffle. What is
    found meets the whole files on ``id``, together with the identifiers that were asked for.
    Hashes meet on the heads of their keys, and the whole key is held against the hash in the same join.
    """
    hashes = asked.where(F.col("kind") == "hash").select("key").distinct()
    heads = _heads(hashes).withColumn("kind", F.lit("hash"))
    wanted = cut(
        keyed.select("uri", "n_requests", F.col("kind").alias("asked_as"), F.col("found_by").alias("kind"), "key")
        .where("key IS NOT NULL").join(heads, ["kind", "key"], "left")
    )
    kinds = wanted.agg(F.collect_set("kind")).first()[0]
    answer = ["id", "uri", "n_requests", F.col("asked_as").alias("kind")]
    typed = lambda side, column: side.withColumn(column, F.col("key").try_cast(origin.schema[column].dataType)).drop("key", "head")
    found = []
    for kind, column in {"jurisdiction": "jurisd_osm_id", "pack": "pack_id"}.items():
        if kind in kinds:
            side = typed(wanted.where(F.col("kind") == kind), column)
            # Places asked for are bounded by the table that is broadcast for the answers, too.
            side = hinted(side, JURISDICTION_BYTES if kind == "jurisdiction" else BROADCAST_BYTES)
            found.append(origin.select("id", column).join(side, column).select(*answer))
    if "hash" in kinds:
        side = wanted.where(F.col("kind") == "hash")
        found.append(_hash_cuts(origin.select("id", "fhash"), side).join(hinted(side, BROADCAST_BYTES), "head").where(F.startswith("_text", "key")).select(*answer))
    if "id" in kinds or not found:
        found.append(typed(wanted.where(F.col("kind") == "id"), "id").select(*answer))
    ids = reduce(DataFrame.unionByName, found)
    return origin.join(ids.hint("merge"), "id").select("uri", "n_requests", "kind", *origin.columns)


def origins(
    requests: DataFrame, origin: DataFrame, jurisdiction: DataFrame, content_type: DataFrame, pack: DataFrame,
    donor: DataFrame,
) -> DataFrame:
    """Origins by jurisdiction, donor, state, id or hash beginning, with ``kx`` from the joined tables.

    ``origin`` has one row per id.
    """
    asked = _origin_requests(requests)
    found = _origins_found(asked, _fact_keys(asked, jurisdiction, pack, donor), origin)
    starred = star(found, jurisdiction, content_type, pack, donor)
    kx = F.struct(
        F.struct(
            F.col("donor_id").alias("id"), F.col("donor_vat_id").alias("vat_id"),
            F.col("donor_shortname").alias("shortname"), F.col("donor_legalname").alias("legalname"),
            F.col("donor_url").alias("url"),
        ).alias("donor"),
        F.struct(
            F.col("jurisd_name").alias("name"), F.col("jurisd_state").alias("state"),
            F.col("jurisd_abbrev3").alias("abbrev3"), F.col("jurisd_isolabel_ext").alias("isolabel_ext"),
        ).alias("jurisd"),
        F.struct("user_resp", "accepted_date", "config_commom", "ctype_id", "ctype_model_geo").alias("pack"),
    )
    return starred.select("uri", "n_requests", "kind", *origin.columns, kx.alias("kx"))


def answer_counts(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Every distinct URI with its number of requests and of answer rows, zero included."""
    counts = answers.groupBy("uri").agg(F.count(F.lit(1)).alias("n_rows"))
    return _distinct(requests).select("uri", "n_requests").join(counts, "uri", "left").select(
        "uri", "n_requests", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def unanswered(requests: DataFrame, answers: DataFrame, errors: dict[int, str]) -> DataFrame:
    """Requests that matched nothing, with an error code: -1 empty, -2 one part only, -3 not found.

    The empty request lists the whole table, so it is unanswered only if the table is empty.
    """
    lost = _distinct(requests).join(answers.select("uri").distinct(), "uri", "left_anti")
    code = F.when(F.col("uri") == "", -1).when(F.col("p2").isNull(), -2).otherwise(-3)
    message = F.when(code == -1, errors[-1]).when(code == -2, errors[-2]).otherwise(errors[-3])
    return lost.select("uri", "n_requests", code.alias("errcod"), message.alias("errmsg"))


def routed(urls: DataFrame, url: str = "url", strict: bool = True) -> DataFrame:
    """Request URLs split into format, module, function and parameter; null format means rejected.

    ``strict`` wants a parameter, as the production host does; the test host takes none as well.
    """
    path = F.element_at(F.split(F.col(url), r"\?"), 1)
    names = r"/([a-z_][a-z0-9_]*)/([a-z_][a-z0-9_]*)"
    tail = "/(.+)" if strict else "(?:/(.*)|)"
    as_json, as_csv = rf"/v1(?:\.json)?{names}{tail}", rf"/v1\.csv{names}{tail}"
    form = F.when(path.rlike(as_json), "json").when(path.rlike(as_csv), "csv")
    part = lambda i: F.when(form == "json", F.regexp_extract(path, as_json, i)).when(
        form == "csv", F.regexp_extract(path, as_csv, i)
    )
    return urls.select(
        "*", form.alias("format"), part(1).alias("module"), part(2).alias("function"), part(3).alias("param")
    )


def endpoint_counts(routes: DataFrame) -> DataFrame:
    """Requests and parameters per endpoint; rejected URLs are the group without a format."""
    return routes.groupBy("format", "module", "function").agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_distinct("param").alias("n_params")
    )


def same_vat_groups(donor: DataFrame) -> DataFrame:
    """Donors whose VAT ids are equal once normalised: the group's size with each member."""
    keyed = donor.select("id", "vat_id", vat_key(F.col("vat_id")).alias("kx_vat_id")).where("kx_vat_id IS NOT NULL")
    groups = keyed.groupBy("kx_vat_id").agg(F.count(F.lit(1)).alias("n_donors"), F.min("id").alias("first_id"))
    return keyed.join(groups.where("n_donors > 1"), "kx_vat_id")
