"""Language ID of raw pages: evidence from markup and address, and the registered query over both tables."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import catalogue, language

MARKUP = [
    ('<!DOCTYPE html><html lang="fr"><p>x', "fr"), ("<HTML class=a LANG='pt-BR'>", "pt"), ('<html dir="ltr"lang=de>', "de"), ('<html xml:lang="es" x="1">', "es"),
    ('<!-- <html lang="en"> --><html><head>', None), ('<html data-lang="en">', None), ('<html lang="">', None), ("<p lang='en'>", None), (None, None),
    ('<html><meta content="de, en" http-equiv="Content-Language">', "de"), ("<html><meta name=a content=en><meta http-equiv=content-language content=fr>", "fr"),
]
ADDRESSES = [
    ("https://a.Example.FR/x.de?y=.es", "a.example.fr", "fr"), ("http://me:pw@h.co.uk:80#z", "h.co.uk", "uk"), ("http://h.de.", "h.de", "de"), ("http://h.de.:8080/", "h.de", "de"),
    ("http://127.0.0.1:80/", "127.0.0.1", None), ("http://localhost/", "localhost", None), ("no address", None, None), ("http:///x", None, None), (None, None, None),
]


def test_evidence_of_pages(spark):
    got = spark.createDataFrame(MARKUP, "html string, want string").select("html", "want", language.markup_language(F.col("html")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    df = spark.createDataFrame(ADDRESSES, "url string, host string, suffix string")
    got = df.select("host", "suffix", language.address_host(F.col("url")).alias("h"), language.address_suffix(F.col("url")).alias("s")).collect()
    assert [(r.h, r.s) for r in got] == [(r.host, r.suffix) for r in got]


def test_pages_without_a_known_word_follow_markup_suffix_and_host(spark):
    langs = ("en", "fr")
    english, french = "the and of that with this", "le la les des que une dans"
    model = language.train([(english, "en"), (french, "fr")] * 5, list(langs))
    page = lambda i, text, said, host: (i, f"http://{host}/{i}" if host else None, f"<html{f' lang={said}' if said else ''}><script>{english}</script><p>{text}")
    rows = [page(i, english, "en", f"h{i % 7}.com") for i in range(30)] + [page(i, french, "fr", f"h{i % 7}.fr") for i in range(30, 60)]
    rows += [page(60, "zz", None, "new.fr"), page(61, "zz", None, "new.com"), page(62, "zz", "fr", None), page(63, "zz", "en", None), page(64, "zz", None, "h1.fr"), (65, None, None)]
    got = {r.page_id: r for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model=model, languages=langs).collect()}
    assert [got[i].lang_id for i in (0, 30, 60, 61, 62, 63, 64)] == ["en", "fr", "fr", "en", "fr", "en", "fr"]
    assert len(got) == 66 and got[30].text_lang == "fr" and not got[65].kept


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_judges_all_documents_and_pages(spark, folder):
    got = catalogue.op10_language_id(spark, folder).cache()
    for name, key in (("documents", "doc_id"), ("pages", "page_id")):
        ids = [r[0] for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key).collect()]
        assert sorted(r[0] for r in got.filter(F.col(key).isNotNull()).select(key).collect()) == sorted(ids)
    # a page's path begins with its language, which is no evidence
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", F.regexp_extract("url", "//[^/]*/([a-z]+)/", 1).alias("path"))
    assert pages.join(got, "page_id").agg(F.avg((F.col("lang_id") == F.col("path")).cast("int"))).first()[0] > 0.95
