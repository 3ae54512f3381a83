"""Queries of the operators over the supplied tables, and SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, embedding_dedup, langid, minhash, mixing, pii, repeats, secret_scan, url_filter
from tidemark.llm.url_filter import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = (Rule("net", "/", True), Rule("example.net", "/en/", False), Rule("example.com", "/de/", True), Rule("org", "/fr/", False))
#: Fixed value: names whose hosts are listed, as a feed of unwanted hosts would.
LISTED_NAMES = ("adult", "ads", "casino", "cheap", "free", "spam")
_LISTED = rf"(^|\.)({'|'.join(LISTED_NAMES)})-"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of canonical URLs that the query filters by: those of pages on hosts with listed names."""
    url = F.col("url")
    host = url_filter.host_of(url)
    return table(spark, sf_dir, "pages").filter(host.rlike(_LISTED)).select(url_filter.canonical(host, url_filter.path_of(url)).alias("url"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listing(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), docs)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_langid": op7_langid,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_repeats": op9_repeats,
    "op10_ann": op10_ann,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PAGES = f"""(select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {_AZ}) host,
coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages)"""
_CANONICAL = "regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')"

SQL: dict[str, str] = {
    "op3_url_filter": f"""with p as {_PAGES}, r as (select *, case
        when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from p),
        l as (select distinct {_CANONICAL} u from p where regexp_matches(host, '{_LISTED}'))
        select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
        when host <> '' and {_CANONICAL} in (select u from l) then 'block' else 'allow' end verdict from r""",
    "op4_minhash_dedup": f"""with recursive d as (select doc_id, regexp_extract_all(translate(text, {_AZ}), '[^\\x20\\x09-\\x0D]+') words from documents),
        w as (select doc_id, unnest(words) a, generate_subscripts(words, 1) i from d where len(words) >= 4),
        g as (select distinct doc_id, a || ' ' || lead(a, 1) over o || ' ' || lead(a, 2) over o || ' ' || lead(a, 3) over o as shingle from w window o as (partition by doc_id order by i)),
        s as (select doc_id, shingle from g where shingle is not null union all select doc_id, array_to_string(words, ' ') from d where len(words) between 1 and 3),
        n as (select doc_id, count(*) size from s group by doc_id),
        t as (select s.doc_id, shingle, size from s join n using (doc_id)),
        l as (select x.doc_id a, y.doc_id b from t x join t y on x.shingle = y.shingle and x.doc_id <> y.doc_id and 100 * x.size >= 80 * y.size and 100 * y.size >= 80 * x.size
            group by x.doc_id, y.doc_id, x.size, y.size having 100 * count(*) >= 80 * (x.size + y.size - count(*))),
        r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on r.b = l.a),
        c as (select a doc_id, min(b) component_id from r group by a)
        select doc_id, coalesce(size, 0) n_shingles, component_id, component_id = doc_id as kept from c left join n using (doc_id)""",
    "op6_mixing": """with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
        s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 k from d group by source),
        w as (select *, (case k % 3 when 0 then 3 when 1 then 1 else 2 end)::double weight, 2.0::double * source_size as cap, (sum(source_size) over ())::bigint total from s),
        v as (select *, (1.5::double * total - coalesce(sum(cap) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level from w
            window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
        t as (select source, source_size, least(cap, weight * max(level) over ()) target from v),
        m as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end rate
            from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, (size * (floor(rate) + case when ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double
            < rate - floor(rate) then 1 else 0 end))::bigint taken from m""",
    "op8_embedding_dedup": """with recursive v as (select vec_id, embedding::double[] e from embeddings
            where len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
        l as (select x.vec_id a, y.vec_id b from v x join v y on len(x.e) = len(y.e) and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.9),
        r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on r.b = l.a),
        c as (select a vec_id, min(b) component_id from r group by a), k as (select a vec_id, count(*) n from l group by a)
        select vec_id, coalesce(n, 0) n_links, component_id, component_id = vec_id as kept from c left join k using (vec_id)""",
    "op9_repeats": """with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
        b as (select doc_id, k * 1000 as base, substr(h, (2000 * k + 1)::bigint, 2198) h from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0), 1000)) // 1000 k from d) x),
        w as (select doc_id, base + i as pos, md5(substr(h, (2 * i + 1)::bigint, 200)) name from (select doc_id, base, h, unnest(range(0, least(1000, len(h) // 2 - 99))) i from b) x),
        p as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by name order by doc_id, pos) n from w) x where n > 1),
        q as (select doc_id, pos, case when pos <= lag(pos) over o + 100 then 0 else 1 end fresh from p window o as (partition by doc_id order by pos)),
        m as (select doc_id, pos, sum(fresh) over (partition by doc_id order by pos) run from q),
        s as (select doc_id, min(pos) lo, max(pos) + 100 hi from m group by doc_id, run),
        g as (select s.*, coalesce(lag(hi) over (partition by doc_id order by lo), 0) upto from s),
        k as (select g.doc_id, sum(hi - lo) removed, count(*) spans, string_agg(substr(h, (2 * upto + 1)::bigint, (2 * (lo - upto))::bigint), '' order by lo) || substr(any_value(h), (2 * max(hi) + 1)::bigint) left_over
            from g join d using (doc_id) group by g.doc_id)
        select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(left_over, h))) kept_sha256 from d left join k using (doc_id)""",
}
