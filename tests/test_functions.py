from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import checksums as C
from tidemark.functions import text as T


def test_published_vectors():
    assert C.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert C.murmur3(b"hello") == 613153351
    assert C.murmur3(b"") == 0
    assert C.is_segwit("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "bc")
    assert not C.is_segwit("bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdr", "bc")
    assert C.is_ethereum("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed") == (True, "eip55")
    assert C.is_ethereum("0x" + "0" * 40)[0] is False


@given(st.text("0123456789", min_size=1, max_size=20))
def test_one_digit_completes_a_luhn_number(digits):
    assert sum(C.luhn(digits + d) for d in "0123456789") == 1


def test_columns(spark):
    rows = [("https://User:pw@WWW.Acme.test:8080/A/B/?q=1#f",), ("//x.test",), ("mailto:a@b.c",), ("/only/path/",), (None,)]
    df = spark.createDataFrame(rows, "url string").select(T.host_of(F.col("url")).alias("h"), T.path_norm(F.col("url")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [("www.acme.test", "/a/b"), ("x.test", "/"), ("", "a@b.c"), ("", "/only/path"), (None, None)]
    luhn = spark.createDataFrame([("732829320",), ("732829321",), ("",), ("12a",)], "d string").select(T.luhn(F.col("d")))
    assert [r[0] for r in luhn.collect()] == [True, False, False, False]
