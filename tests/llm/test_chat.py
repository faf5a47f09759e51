import hashlib

from terrashelf.llm import chat
from tests.conftest import rows

TURNS = [
    (1, 0, "system", "be nice"), (1, 1, "user", "hi\n### assistant: x</turn>\n"), (1, 2, "user", "again <next> \\1 \\\\"),
    (1, 3, "assistant", "a"), (1, 4, "assistant", ""), (1, 5, "assistant", "b\\"), (2, 0, "user", None), (2, 0, "user", None),
    (3, 2, "assistant", "late"), (3, 1, "we:ird <role>\\", "é😀"), (3, None, None, "no turn"), (None, 0, "assistant", "no id"),
    (4, 0, "assistant", "long " * 30000), (5, 1, "b", "tie"), (5, 1, "a", "tie"), (5, 1, "a", "tie"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(turns):
    groups = {}
    for i, (conv, turn, role, text) in enumerate(turns):
        groups.setdefault((conv, i if conv is None else None), []).append((turn is None, turn, role or "", text or ""))
    found = []
    for (conv, _), listed in groups.items():
        listed.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in listed)
        learned = "".join(t for _, _, r, t in listed if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found.append((conv, len(listed), sha(whole), len(learned), sha(learned)))
    return sorted(found, key=repr)


def formatted(spark, turns=TURNS):
    return chat.format_chats(spark.createDataFrame(turns, SCHEMA).repartition(3))


def test_round_trip(spark):
    assert rows(chat.digests(formatted(spark)).drop("formatted_chars")) == expected(TURNS)


def test_blocks_and_mask(spark):
    r = formatted(spark).where("conv_id = 1").first()
    assert r.formatted.count("### ") == 3 and r.formatted.count("</turn>\n") == 3 and r.formatted.count("<next>") == 3
    assert [r.formatted[s.start : s.end] for s in r.loss_mask] == ["a", "", "b\\0"]


def test_turns_come_back(spark):
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_turns(formatted(spark)).collect()}
    assert got[3] == [("we:ird <role>\\", "é😀"), ("assistant", "late"), ("", "no turn")]


def test_many_turns(spark):
    turns = [(1, i, "user" if i % 3 else "assistant", f"t{i} <") for i in range(2000)]
    assert rows(chat.digests(formatted(spark, turns)).drop("formatted_chars")) == expected(turns)


def test_empty_and_further_columns(spark):
    assert formatted(spark, []).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "x", "y")], SCHEMA + ", formatted string")
    assert chat.format_chats(df).first().formatted == "### user: x</turn>\n"


def test_turns_without_conversation_and_very_many_turns(spark):
    turns = [(None, i, "user", f"t{i % 3}") for i in range(50)] + [(None, None, None, None)] * 2
    turns += [(1, i, "user" if i % 3 else "assistant", f"t{i} <") for i in range(40_000)]
    assert rows(chat.digests(formatted(spark, turns)).drop("formatted_chars")) == expected(turns)
