"""Extra columns whose names operators use for what they add or need on the way."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, bpe, embedding_dedup, langid, minhash, mixing, pii, repeats, secret_scan, url_filter
from tidemark.llm.catalogue import RULES

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
NAMES = (
    "_id _set _key key kept label text_ node a b depth region rate target _source source_size size copies copy _copy _u _block _probe _hit w0 _canonical _listed "
    "host path rule verdict _cands _secrets _n lang_pred score phrase_rate unlearned _digest _terms _found _base _all digest base entities sha body ids n_tokens n_shingles component_id"
).split()


def clashing(df):
    return df.select("*", *(F.concat(F.lit(f"{n}="), F.monotonically_increasing_id().cast("string")).alias(n) for n in NAMES if n not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    text = "the of and to in is was for that with a word of number "
    rows = [(i, text * 3 + f"n{i} AKIAMD62HKU6VBLCCC{i:02d} ann@example.org", "en", "s", 1) for i in range(12)] + [(20, text * 3 + "n1 tail", "en", None, 1), (21, None, None, None, None)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


RETURNS_ALL = {
    "mix": mixing.emit,
    "dedup": minhash.deduplicated,
    "redacted": secret_scan.redacted,
    "language": langid.in_a_language,
    "sanitised": pii.sanitised,
    "listed": lambda d: url_filter.listed(d, "source", d.select(F.lit("s").alias("url")), out="is_listed").drop("is_listed"),
    "stage language_id": lambda d: corpus_pipeline.language_id(d.sparkSession, d, ""),
    "stage secret_scan": lambda d: corpus_pipeline.secrets(d.sparkSession, d, ""),
    "stage mixing": lambda d: corpus_pipeline.mix(d.sparkSession, d, ""),
    "stage minhash_dedup": lambda d: corpus_pipeline.minhash_dedup(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("name", RETURNS_ALL)
def test_columns_come_back_as_they_were(docs, name):
    out = RETURNS_ALL[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(str(r[n]).startswith(f"{n}=") for r in rows for n in NAMES)
    assert RETURNS_ALL[name](docs.limit(0)).count() == 0


OWN = {
    "mix": mixing.mix,
    "near": minhash.near_duplicates,
    "report": secret_scan.report,
    "private": pii.find_private,
    "identify": langid.identify,
    "repeats": repeats.remove_repeats,
    "bpe": lambda d: bpe.digests(d, RANKS, P.PATTERN),
    "judge": lambda d: url_filter.judge(d.withColumn("url", F.lit("a://b/c")), RULES, d.select(F.lit("b/c").alias("url"))).filter("verdict = 'block'"),
}


@pytest.mark.parametrize("name", OWN)
def test_own_columns_are_right_beside_others(docs, name):
    plain = docs.drop(*NAMES)
    assert OWN[name](docs).count() == docs.count()
    want = OWN[name](plain)
    new = [c for c in want.columns if c not in plain.columns or c == "doc_id"]
    got = OWN[name](docs).select(*new)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*new).collect()))


def test_vectors_beside_other_columns(spark):
    df = clashing(spark.createDataFrame([(i, [1.0, i / 9]) for i in range(10)], "vec_id long, embedding array<double>")).select("*", F.lit(0).alias("n_dim"), F.lit(0).alias("vec"), F.lit(0).alias("cell"), F.lit(0).alias("asked"), F.lit(0).alias("rank"))
    assert embedding_dedup.near_duplicates(df).count() == 10
    assert ann.search(df, F.col("asked") == 0).count() == 50
