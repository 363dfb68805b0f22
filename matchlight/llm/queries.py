"""The registered queries of this package, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlight.llm import (
    chat,
    decontaminate,
    licenses,
    lm,
    negatives,
    neighbors_graph,
    packing,
    secrets,
    simhash,
    suffixes,
    tokens,
    toxicity,
    whitening,
)
from matchlight.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def named(key: str, sql: str | None = None):
    def register(run):
        QUERIES[key] = run
        if sql:
            CHECKS[key] = sql
        return run

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(CHECKS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@named("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = suffixes.remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    return docs.select("doc_id", *suffixes.text_keys()).join(texts, ["k1", "k2"]).drop("k1", "k2")


@named("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@named("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@named("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.pieces(table(spark, sf_dir, "documents")), "pieces"))


@named("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = stored(simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=3), "simhash")
    found = simhash.near_duplicates(fps, 1, 3, simhash.exact_plan())
    return found.select("doc_id", simhash.hex_text("f0").alias("fingerprint"), "component_id")


@named("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key").distinct()


@named("op7_vectors")
def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


@named("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@named("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@named("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@named(
    "op11_chat_trees",
    r"""with chats as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '\### Assistant: </turn> ok'
      union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    lengths as (
      select *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) as text_chars,
        length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) as role_chars
      from chats),
    told as (
      select conv_id, count(*) as n_turns,
        string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
        coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
        cast(sum(14 + role_chars + text_chars) as bigint) as formatted_chars
      from lengths group by conv_id)
    select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
      formatted_chars
    from told""",
)
def op11_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(chats))


@named("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@named(
    "op13_hard_negatives",
    """with v as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: floor(cast(c as double) * 256)) as x
      from embeddings
      where vec_id is not null and label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    pairs as (
      select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
        cast(list_dot_product(a.x, b.x) as bigint) as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
    positives as (
      select anchor_id, other_id as positive_id, score as positive_score from pairs where same
      qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
    ranked as (
      select p.anchor_id, positive_id, positive_score, n.other_id as negative_id, n.score as negative_score,
        cast(row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.other_id) as int) as rank
      from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
        and 100 * n.score between 80 * positive_score and 100 * positive_score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)
