"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, decontamination, jaccard, licenses, negatives, quality, secrets, sharding, spelling, token_counts, token_files, wacz
from .registry import query, table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2
TOKEN_LIMIT = 2048


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded and decoded again; digests of the ids and of the decoded texts."""
    path = public_tokenizers.path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts and the documents beyond the limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(WORD_BPE))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


@query("op8_warc_packages")
def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in ZIP packages, read back by range."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    )
    folder = wacz.package_folder(spark)
    packages = wacz.write_packages(wacz.mark_revisits(pages, min_bytes=0), folder)
    return wacz.read_packages(packages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in seekable files in ascending doc_id order, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write_token_files(
        docs, public_tokenizers.path(BYTE_BPE), END_ID, token_files.token_file_folder(spark)
    )
    return token_files.read_token_files(spark, files).select(
        F.col("key").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts of the base kinds, digest of the base spans, all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s.kind != "guess")
    return found.select(
        "doc_id",
        *[secrets.count(spans, kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(spans).alias("spans"),
    )


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the line field, fitted on a bounded sample of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit_lines(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, field).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "content_share", "kept",
    )


SHARDS = 24


@query("op1_shards")
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards whose row counts differ by one at most; digests of the texts that arrived."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shuffle_into_shards(docs, SHARDS, ["doc_id", "text"]).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand, copied or edited, in documents: a row per document and item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.match_items(docs, table(spark, sf_dir, "benchmark"))
    return (
        found.filter(F.size("matches") > 0)
        .select("doc_id", F.explode("matches").alias("m"))
        .select("doc_id", "m.item_id", "m.score", F.col("m.start").alias("first_word"), F.col("m.end").alias("end_word"))
    )


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their five-word shingles."""
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, each by its own license."""
    return licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), own_only=True)


DAMAGE = 97

#: CRC-32 by bytes, as DuckDB has no function for it; words with all one-deletion strings, joined on these.
SPELLING_SQL = """
with recursive step(b, k, c) as (
    select b::uinteger, 0, b::uinteger from range(256) t(b)
    union all
    select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::uinteger) else c >> 1 end from step where k < 8
),
tab as (select list(c order by b) as t from step where k = 8),
runs as (
    select doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as run
    from documents where text is not null
),
distinct_runs as (select doc_id, run, count(*) as n from runs group by all),
coded as (
    select run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from distinct_runs
),
bytes as (
    select run, n,
        list_prepend(4294967295::uinteger, list_transform(range(0, length(x) // 2),
            lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 17)::uinteger))
            as b
    from coded
),
hashed as (
    select run, n, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[xor(c & 255, v)::bigint + 1])), 4294967295::uinteger)::bigint as h
    from bytes, tab
),
given as (
    select case when h % 97 = 0 then run[: (h % length(run))] || run[(h % length(run)) + 2 :] else run end as word, n from hashed
),
words as (
    select word, sum(n)::bigint as n from given where length(word) >= 5 group by word having sum(n) >= 3
),
holes as (
    select word, n, length(word) as len, k, word[: k - 1] || word[k + 1 :] as hole
    from words, unnest(range(1, length(word) + 1)) as r(k)
),
near as (
    select a.word as a, b.word as b from holes a join holes b on a.hole = b.hole and a.k = b.k and a.len = b.len and a.word <> b.word
    union select a.word, b.word from holes a join words b on a.hole = b.word
    union select b.word, a.word from holes a join words b on a.hole = b.word
),
best as (
    select a as word, count(*) as n_near, max(w.n) as top_n, arg_min(b, (-w.n, b)) as top
    from near join words w on w.word = near.b group by a
),
formed as (
    select words.word, words.n, coalesce(n_near, 0) as n_near,
        case when top_n >= 2 * words.n then top end as form, case when top_n >= 2 * words.n then top_n end as form_n
    from words left join best using (word)
),
chain(word, here) as (
    select word, word from formed
    union all
    select chain.word, formed.form from chain join formed on formed.word = chain.here where formed.form is not null
),
ends as (select chain.word, chain.here as root from chain join formed on formed.word = chain.here where formed.form is null)
select formed.word, form, root, n, n_near, form_n from formed join ends using (word)
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their neighbours by one code point, and the forms they vary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variant_groups(spelling.count_words(docs, damage=DAMAGE))


FOLDS = 5  # rows of the first fold are held out of the fit
GOOD = 0.3


@query("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by trees that never saw the labels of the held-out ones."""

    def held_out():
        return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = classifier.fit_trees(docs.filter(~held_out()), labels.filter(~held_out()))
    return classifier.with_scores(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


NEGATIVES_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
    select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as s
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
positives as (
    select a, b as p, s as ps from scores where same qualify row_number() over (partition by a order by s desc, b) <= 5
),
found as (
    select positives.a as anchor_id, p as positive_id, b as negative_id, ps as positive_score, s as negative_score,
        row_number() over (partition by positives.a, p order by s desc, b)::int as rank
    from positives join scores on scores.a = positives.a and not same and 80 * ps <= 100 * s and s <= ps
)
select * from found where rank <= 5
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives just below the positives of every hundredth vector; every seventh vector's label is shifted."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.scaled(rows.withColumn("label", shifted), 256.0)
    return negatives.hard_negatives(vectors, F.col("id") % 100 == 0)
