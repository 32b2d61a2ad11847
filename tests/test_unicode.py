"""Unicode folding against the standard library."""

import re
import unicodedata

from pyspark.sql import functions as F

from panelwright.functions.unicode import fold


def test_fold_equals_the_standard_library(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    texts = ["", None, "Plain ASCII\t\x0b\x1c text", "ＣＰＩ　同比", "ﬁ ½ ² Ⅷ ㎏ ①", "é É ΑΣ ΣΑ İ ẞ", "ｱﾊﾟｰﾄ", "a" + spaces + "b", "𝐀𝟙", "한글한", "x" * 5000 + "　"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.t for r in frame.select("id", fold(F.col("text")).alias("t")).collect()}
    for k, text in enumerate(texts):
        assert got[k] == (None if text is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", text)).lower()), texts[k][:20]
    assert frame.limit(0).select(fold(F.col("text"))).count() == 0
