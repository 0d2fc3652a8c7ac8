"""The token histogram covers texts that are not ASCII."""

import re
import unicodedata
from collections import Counter

from wagetide.queries import QUERIES


def tokens(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).upper()
    t = re.sub(r"\bLIMITED\b", "LTD", re.sub(r"\bPUBLIC LIMITED COMPANY\b", "PLC", t, flags=re.A), flags=re.A)
    return re.findall("[A-Z0-9]+", t)


def test_all_documents_are_counted(spark, tmp_path):
    texts = ["Café naïve — “quoted” text", "plain text", "ﬁne Ångström Limited", "Übergröße 42", None, "", "漢字 mixed ½"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["token"]: r["n"] for r in QUERIES["n_token_counts"](spark, str(tmp_path)).collect()}
    assert got == Counter(x for t in texts for x in tokens(t)) and got["CAFE"] == 1 and got["TEXT"] == 2


def test_tables_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["token"]: r["n"] for r in QUERIES["n_token_counts"](spark, sf).collect()}
    assert got == Counter(x for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for x in tokens(r["text"]))
