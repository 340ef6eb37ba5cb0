"""Properties over generated texts; each example is one small table."""

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from washboard.functions import text as T
from washboard.operators import cells
from washboard.operators.tracked import TrackedFrame
from washboard.rules import ColumnRule, RulePack

SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　"
ANY = st.text(st.sampled_from("aZ09-+.#/'é,()" + SPACES), max_size=14)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
RULES = (ColumnRule("phone", "cell_no"), ColumnRule("card", "cnic"), ColumnRule("word", casing="title", special_chars_ok=True))
PACK = RulePack(rules=RULES)


@SLOW
@given(st.lists(ANY, min_size=5, max_size=40))
def test_text_functions_equal_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows(df.select("t", T.collapse_ws("t"), T.strip_ws("t"), T.null_like("t"), T.strip_special("t"), T.title_case(T.strip_special("t"))))
    for t, collapsed, stripped, empty, special, title in found:
        assert collapsed == " ".join(t.split())
        assert stripped == t.strip()
        assert empty == (t.strip().lower() in PACK.null_tokens)
        kept = "".join(c if (c.isascii() and c.isalnum()) or c in "-." else " " for c in t)
        assert special == " ".join(kept.split())
        assert title == special.title()


NUMBERS = st.one_of(
    st.from_regex(r"\A(\+92|0092|92|0)?[ -]?3[0-9]{9}\Z"), st.from_regex(r"\A[0-9]{5}-[0-9]{7}-[0-9]\Z"), ANY, st.none()
)


@SLOW
@given(st.lists(st.tuples(NUMBERS, NUMBERS, ANY), min_size=5, max_size=30))
def test_steps_are_idempotent(spark, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "row_idx long, phone string, card string, word string")

    def once(frame):
        t = cells.null_standardize(cells.trim_whitespace(TrackedFrame.begin(frame)), PACK)
        return cells.apply_rules(t, PACK)

    first = once(df)
    out = first.cleaned()
    assert out.count() == len(data)
    again = {r["row_idx"]: r for r in once(out).cleaned().collect()}
    for r in out.collect():
        word = r["word"] if r["word"] is None or r["word"].lower() not in PACK.null_tokens else None
        assert (r["phone"], r["card"]) == (again[r["row_idx"]]["phone"], again[r["row_idx"]]["card"])
        assert word == again[r["row_idx"]]["word"]
    touched = first.cells().where("steps <> ''").count()
    masks = first.df.select(*[(first.mask(n) != 0).cast("int").alias(n) for n in first.names])
    assert touched == sum(sum(r) for r in rows(masks))
    assert first.df.where(F.col("f0").isNull()).count() == 0
