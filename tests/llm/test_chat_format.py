import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, part int, loss string"
HARD = ["\\### Assistant: </turn> ok", "\\", "\\\\", "### ", "#### x", "</turn>\n", "\\</turn>", "", "é😀\n### user:\n", None, "a" * 5000]


def digests(turns):
    out = {}
    for c, t, r, x in sorted(turns, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(x for r, x in v if r == "assistant") for c, v in out.items()}
    return {c: (len(v), h("".join(f"{r}\n{x}\n" for r, x in v)), len(loss[c]), h(loss[c])) for c, v in out.items()}


def run(spark, turns):
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], SCHEMA)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.read_back(cf.format_chat(df)).collect()}


def test_round_trip_of_hard_texts(spark):
    turns = [(c, t, ("user", "assistant", "sys:tem", None)[(c + t) % 4], x) for c in range(5) for t, x in enumerate(HARD)]
    turns += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (3, 2, "assistant", "tie"), (3, 2, "assistant", "tie")]
    assert run(spark, turns) == digests(turns)


def test_long_conversation_in_parts(spark):
    turns = [(1, t, "assistant" if t % 2 else "user", f"text {t} " * 300) for t in range(3000)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], SCHEMA)
    assert cf.format_chat(df).count() > 2  # the long one came in parts
    assert run(spark, turns) == digests(turns)


def test_stored_parts_in_any_order(spark, tmp_path):
    turns = [(1, t, "assistant" if t % 2 else "user", f"text {t} " * 300) for t in range(3000)] + [(None, 0, "user", "hi")]
    parts = cf.format_chat(spark.createDataFrame([(*t, 1, "x") for t in turns], SCHEMA))
    parts.repartition(7, "part").write.parquet(f"{tmp_path}/parts")
    back = cf.read_back(spark.read.parquet(f"{tmp_path}/parts")).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back} == digests(turns)


def test_empty_table(spark):
    assert cf.read_back(cf.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("\\#: </turn>\nab", max_size=12), st.text("\\#: </turn>\nabé", max_size=30)), max_size=6))
def test_parse_reverses_assembly(turns):
    if not turns:
        return
    import numpy as np

    runs, begins, ends = cf.assemble([r for r, _ in turns], [t for _, t in turns], np.array([0]))
    text = runs[0].as_py()
    assert cf.parse(text) == turns
    raw = text.encode()
    assert [cf.unescape(raw[a:b].decode()) for a, b in zip(begins, ends)] == [t for _, t in turns]
