"""One query per operator over its whole table, with DuckDB statements where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, exact_dedup, html, mixing, near_dedup, nearest, packing, quality, resampling, rules, secrets, sharding, statements, toxicity
from .common import held_out, table

#: The vocabulary that op4 and the pipeline count tokens with.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, {"text_sha256": F.sha2(F.coalesce(docs["text"], F.lit("")), 256)})


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), quality.score(forest, docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary_path())
    return packing.pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", secrets.of_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.concat("base", "added")).alias("spans"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), toxicity.score(model, docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"),
                        F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rules.judge(docs, rules.order(docs), rules.BASE_STATISTICS)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", *rules.BASE_STATISTICS, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


QUERIES = [op1_exact_dedup, op2_quality, op3_sharding, op4_best_fit_packing, op5_secret_scan, op6_html_extraction, op7_nearest_neighbours, op8_toxicity, op9_source_mixing, op10_minhash_near_dedup,
           op11_importance_resampling, op12_conversation_trie, op13_quality_rules]

def _secrets_sql() -> str:
    """Positions from matches and the gaps between them, windows one by one; DuckDB's patterns have no look-behind."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    classes = secrets.CLASSES
    kinds = [("assign", secrets.ASSIGN, 2, 8), ("access", secrets.ACCESS, 0, 0), ("hex", secrets.HEX, 0, 0),
             ("hex_entropy", "[A-Za-z0-9]{20,}", 0, 0), ("base64_entropy", classes["base64_entropy"][0], 0, 0)]
    found = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        found.append(f"""select doc_id, {k} as ord, '{kind}' as kind, ends[i] - length(m[i]) as s, ends[i] as e, m[i] as said from (
            select *, unnest(range(1, len(m) + 1)) as i from (
              select *, list_transform(range(1, len(m) + 1), lambda i: cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) as bigint)) as ends
              from (select doc_id, regexp_extract_all(text, p, 0) as m, regexp_extract_all(text, p, {group}) as v, string_split_regex(text, p) as gaps
                from (select doc_id, coalesce(text, '') as text, {quoted(pattern)} as p from documents) where regexp_matches(text, p))))
            where length(v[i]) >= {least}""")
    allowed = " or ".join(f"regexp_matches(said, {quoted(a)})" for a in secrets.ALLOW)
    bits = f"case ord when 3 then {classes['hex_entropy'][2]} else {classes['base64_entropy'][2]} end - 1e-9"
    n = secrets.WINDOW
    return f"""with f as materialized ({" union all ".join(found)}),
        b as (select * from f where ord < 3),
        c as (select * from f where ord > 3 or ord = 3 and regexp_full_match(said, '[0-9A-Fa-f]+')),
        h as (select *, list_filter(range(1, length(said) - {n - 2}), lambda i: list_entropy(string_split(said[i:i + {n - 1}], '')) >= {bits}) as hot from c where not ({allowed})),
        a as (select doc_id, ord, kind, s + hot[1] - 1 as s, s + hot[-1] + {n - 1} as e from h where len(hot) > 0),
        o as (select doc_id, ord, kind, s, e from b union all
          select doc_id, ord, kind, s, e from a where not exists (select 1 from b where b.doc_id = a.doc_id and b.s < a.e and a.s < b.e)),
        g as (select doc_id, count(*) filter (ord = 0) as n_assign, count(*) filter (ord = 1) as n_access, count(*) filter (ord = 2) as n_hex,
          string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (ord < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as spans from o group by doc_id)
        select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
          sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join g using (doc_id)"""


SQL = {
    "op1_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') as text from documents)
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
          doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
        from t window same as (partition by text)""",
    "op7_nearest_neighbours": """
        with v as (select distinct vec_id, cast(embedding as double[]) as x from embeddings
          where vec_id is not null and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c)))
            and list_bool_or(list_transform(embedding, lambda c: c <> 0))),
        d as (select q.vec_id as query_id, q.x, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.x, v.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) as score
          from v q join v on q.vec_id % 100 = 0 and (q.vec_id <> v.vec_id or q.x <> v.x) and len(q.x) = len(v.x)),
        r as (select query_id, cast(row_number() over (partition by query_id, x order by score, vec_id) as integer) as rank, vec_id, score from d)
        select * from r where rank <= 10""",
    "op10_minhash_near_dedup": r"""
        with recursive w as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then []
            when len(w) < 5 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
        u as (select doc_id, unnest(s) as x from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
        l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
        r as (select doc_id as a, doc_id as b from s
          union select r.a, n.b from r join (select a, b from l union all select b, a from l) n on n.a = r.b)
        select s.doc_id, len(any_value(s.s)) as n_shingles, min(r.b) as component_id, s.doc_id = min(r.b) as kept
        from s join r on r.a = s.doc_id group by s.doc_id""",
    "op5_secret_scan": _secrets_sql(),
    "op11_importance_resampling": statements.resampling(),
    "op12_conversation_trie": statements.trie(),
    "op13_quality_rules": statements.rules(),
}


def llm_queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def llm_sql() -> dict[str, str]:
    return dict(SQL)
