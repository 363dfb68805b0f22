"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base spans (assignments, access ids, long hex) are reported as they match. A weak candidate (a
mixed random-looking string, or a value after a loose keyword) is reported only if a complementary
part, an identifier or an endpoint, lies within the scope: at most ``SCOPE`` code points away in
the same document. Everything is SQL functions: match texts and the gaps between them
give the offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight.session import stored

SCOPE = 200

# The base patterns, in listed order, and the least length of what they match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of hex digits is matched as a whole, so the length can be asked for
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

# Parts that mean something only together.
IDENTIFIER = (
    r"""(?i:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|tenant(?:_?id)?))"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
)
ENDPOINT = (
    r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]{4,}"""
    r"""|(?i:\b(?:host|endpoint|server|url))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}"""
)
WEAK = (
    r"""(?i:\b(?:pwd|pass|auth|credential|private_?key|signature))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{8,}"""
    r"""|(?<![A-Za-z0-9+/])(?=[a-z+/]*[0-9A-Z][^\x00-\x20]*)(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])"""
    r"""[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/])"""
)
PARTS = (("identifier", IDENTIFIER), ("endpoint", ENDPOINT), ("weak", WEAK))

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(found: str, gaps: str, value: str, kind: str, rank: int, least: int) -> Column:
    """Spans from matched texts, the texts between them and the values whose length counts."""
    return F.expr(
        f"""case when size({found}) > 0 then aggregate(sequence(1, size({found})),
          named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
          (a, i) -> named_struct('at', a.at + length({gaps}[i - 1]) + length({found}[i - 1]),
            'out', if(length({value}[i - 1]) >= {least}, concat(a.out, array(named_struct(
              'start', a.at + length({gaps}[i - 1]), 'rank', {rank},
              'end', a.at + length({gaps}[i - 1]) + length({found}[i - 1]), 'kind', '{kind}'))), a.out)),
          a -> a.out) else cast(array() as array<{SPAN}>) end"""
    )


def _located(df: DataFrame, kinds) -> DataFrame:
    """Add a column of spans per (kind, pattern, counted group, least length, rank)."""
    text = F.col("text")
    df = df.withColumns(
        {f"{k}_found": F.when(ready, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p, _, _, _, ready in kinds}
    )
    extra = {}
    for k, p, group, _, _, _ in kinds:
        some = F.size(f"{k}_found") > 0
        extra[f"{k}_gaps"] = F.when(some, F.split(text, p, -1))
        if group:
            extra[f"{k}_value"] = F.when(some, F.regexp_extract_all(text, F.lit(p), F.lit(group)))
    df = df.withColumns(extra)
    return df.withColumns(
        {
            k: _spans(f"{k}_found", f"{k}_gaps", f"{k}_value" if group else f"{k}_found", k, rank, least)
            for k, _, group, least, rank, _ in kinds
        }
    ).drop(*[f"{k}_{x}" for k, *_ in kinds for x in ("found", "gaps", "value")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, base, parts): sorted base spans and the parts outside them.

    One row per input row; a NULL text counts as empty and has no spans.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("text_key", F.xxhash64("text"))
    yes = F.lit(True)
    df = _located(df, [(k, p, g, n, i, yes) for i, (k, p, g, n) in enumerate(BASE)])
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).drop("hex")
    linkable = (F.size("access") > 0) | F.col("text").rlike(f"{IDENTIFIER}|{ENDPOINT}")
    df = df.withColumn("linkable", linkable)
    df = _located(df, [(k, p, 0, 1, 3 + i, F.col("linkable")) for i, (k, p) in enumerate(PARTS)])
    outside = F.expr("filter(weak, w -> not exists(base, b -> b.start < w.end and w.start < b.end))")
    ids = F.expr("transform(access, s -> named_struct('start', s.start, 'rank', 3, 'end', s.end, 'kind', 'identifier'))")
    return df.select(
        "doc_id",
        "text_key",
        "base",
        F.when(
            F.size(outside) > 0, F.concat(ids, "identifier", "endpoint", outside)
        ).alias("parts"),
    )


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_key, added): weak candidates with a complementary part within the scope.

    The scope is an interval around a candidate. Both sides go to cells of the scope's length, a
    part to its own cell and both neighbours, so the join is on equal keys.
    """
    part = (
        scanned.where(F.size("parts") > 0)
        .select("doc_id", "text_key", F.explode("parts").alias("part"))
        .select("doc_id", "text_key", "part.kind", "part.start", "part.end")
        .distinct()
    )
    # A candidate longer than a cell is cut into as many cells as it covers.
    weak = part.where("kind = 'weak'").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))
    )
    other = (
        part.where("kind <> 'weak'")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)))
        .select("doc_id", "text_key", "cell", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    )
    w, o = weak.alias("w"), other.alias("o")
    near = (F.col("o.o_start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("o.o_end") <= scope)
    hits = w.join(
        o,
        F.col("w.doc_id").eqNullSafe(F.col("o.doc_id"))
        & (F.col("w.text_key") == F.col("o.text_key"))
        & (F.col("w.cell") == F.col("o.cell"))
        & near,
        "left_semi",
    )
    span = F.struct(
        F.col("start"), F.lit(3).alias("rank"), F.col("end"), F.lit("multipart").alias("kind")
    )
    return hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(span)).alias("added"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_key, base, added): one row per input row, spans in code points, end exclusive.

    ``base`` holds assign, access and hex spans, ``added`` the linked candidates. Spans of different
    kinds may overlap.
    """
    scanned = stored(scan(docs, id_col, text_col), "secrets")
    extra = linked(scanned, scope).withColumnsRenamed({"doc_id": "x_id", "text_key": "x_key"})
    return scanned.join(
        extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("text_key") == F.col("x_key")), "left"
    ).select(
        "doc_id",
        "text_key",
        "base",
        F.coalesce("added", F.expr(f"cast(array() as array<{SPAN}>)")).alias("added"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""

    def amount(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[amount(kind) for kind, *_ in BASE],
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each maximal run of covered code points replaced by the mask.

    ``spans`` must be sorted by start; overlapping ones are masked once.
    """
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
    )
    tail = F.substring(text, step["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(step["out"], ""), tail)).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """All documents with their own columns; texts with secrets are redacted, n_chars follows.

    Rows are never dropped. A NULL text stays NULL.
    """
    found = find_secrets(docs).withColumn("all", F.array_sort(F.concat("base", "added")))
    found = stored(
        found.where(F.size("all") > 0)
        .dropDuplicates(["doc_id", "text_key"])
        .select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), F.col("all").alias("s_spans")),
        "found",
    )
    name = "key_of_" + "_".join(docs.columns)
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(found["s_id"]) & (keyed[name] == found["s_key"])
    text = F.when(found["s_spans"].isNull(), keyed["text"]).otherwise(redact(keyed["text"], found["s_spans"]))
    return keyed.join(found, same, "left").select(
        *[
            text.alias(c)
            if c == "text"
            else F.when(found["s_spans"].isNull(), keyed[c]).otherwise(F.length(text)).cast(t).alias(c)
            if c == "n_chars"
            else keyed[c]
            for c, t in docs.dtypes
        ]
    )
