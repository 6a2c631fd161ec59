"""Bodies are cleaned in slices of bounded size, with the same results."""

import pyarrow as pa
from pyspark.sql import functions as F

from storyloom.functions import markup
from storyloom.functions import text as X


def test_slices_give_what_single_bodies_give():
    bodies = ["<p>a</p>", None, "", "x" * 50, "<b onclick=1>é</b>", "plain & simple", None] * 9
    one = markup.clean_markup
    for limit in (1, 7, 64, 10**9):
        assert [v.as_py() for v in markup.clean_slices(pa.array(bodies, pa.string()), limit)] == [one(b) for b in bodies]
    assert len(markup.clean_slices(pa.array([], pa.string()))) == 0


def test_start_of_a_text_is_squeezed_as_the_whole(spark):
    texts = ["", " ", "a", " a  b ", "\t" * 500 + "end", "word " * 400, ("a" + " " * 90) * 60, "x" * 41 + "　 " * 300 + "y", " " * 39 + "b" * 5, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.squeeze(F.col("t")).alias("whole"), X.squeeze_start(F.col("t"), 10).alias("start")).collect()
    for r in rows:
        assert r.start == r.whole or (len(r.start) > 10 and r.whole.startswith(r.start))
    assert any(r.start is not None and r.start != r.whole for r in rows)
