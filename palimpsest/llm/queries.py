"""The corpus operators as registered queries: thin, on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, codes, decontaminate, html, linededup, minhash, negatives, packing, pq, rules, sentencepiece_codec, shard, warc
from palimpsest.llm.common import table


#: A document whose score is lower is rejected.
GOOD = 0.7


def piece_model() -> str:
    """Where the SentencePiece model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, their spans and the text they decode to, as counts and digests."""
    out = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("spanned_bytes"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the one that quotes control strings, formatted and read back from the output."""
    own = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.conversations(chat.chains(turns), best=1)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    out = out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask")))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(9 + length(role) + length(
    regexp_replace(replace(text, '\', '\\'), '(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with the edits between them."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates, and whether it is the one that stays."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("component").alias("component_id"), "kept")


#: Shingles told apart by occurrence, so that shared and all of two documents' are those of their counts.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_\x{80}-\x{10ffff}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) ELSE [array_to_string(w, ' ')] END) AS gram FROM words WHERE len(w) > 0),
once AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id, gram) AS n FROM grams),
size AS (SELECT doc_id, count(*) AS n FROM once GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM once a JOIN once b ON a.gram = b.gram AND a.n = b.n AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-9),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT node AS doc_id, min(root) AS component_id, min(root) = node AS kept FROM reach GROUP BY node
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that are later copies of repeated runs, and its text without them."""
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        "n_lines",
        F.size("dropped").alias("n_dropped"),
        F.array_join("dropped", ",").alias("dropped_lines"),
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


#: Runs of lines that just hold 50 words, forwards and backwards; every copy of one but the first goes.
OP5_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE length(text) > 0),
w AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
runs AS (
  SELECT a.doc_id, a.i AS lo, min(b.i) AS hi FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 50 AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.i) AS lo, a.i AS hi FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 50 AND a.i AND a.upto - b.upto + b.words >= 50 GROUP BY ALL),
named AS (SELECT r.doc_id, lo, hi, sha256(string_agg(line, chr(10) ORDER BY i)) AS run FROM runs r JOIN l ON l.doc_id = r.doc_id AND i BETWEEN lo AND hi GROUP BY ALL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS n FROM named) WHERE n > 1),
gone AS (SELECT DISTINCT l.doc_id, i FROM later r JOIN l ON l.doc_id = r.doc_id AND i BETWEEN lo AND hi),
told AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY l.i), '') AS dropped_lines,
  coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped, coalesce(dropped_lines, '') AS dropped_lines,
  length(coalesce(kept, text)) AS kept_chars, sha256(coalesce(kept, text)) AS kept_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in forty shards of equal counts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
    )
    return shard.deal(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's links at a cosine of 0.9 or more, and its component."""
    found = pq.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, v.vec_id) AS component_id,
  v.vec_id IS NULL OR v.vec_id = component_id AS kept
FROM v LEFT JOIN least ON node = v.vec_id LEFT JOIN counted ON counted.a = v.vec_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by rules learnt from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.score(docs, model).select(
        "doc_id",
        rules.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.archive_folder(spark)
    written = warc.write_archives(warc.plan_records(pages, revisit_from=0), folder, warc.train(pages))
    return warc.read_archives(written, folder).select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS f FROM h),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda x: ['0000', '0001', '0010', '0011', '0100', '0101',
  '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', x)]), '') AS bits FROM f)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5),
    lambda j: CASE WHEN substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) = '1' THEN 1 << CAST(4 - j AS INTEGER) ELSE 0 END)) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM b
"""


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth embedding; every seventh label is shifted."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(CASE WHEN len(a.e) = len(b.e) THEN list_inner_product(a.e, b.e) END AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


def word_tokenizer() -> str:
    """The word tokenizer's file, as text."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 4,096."""
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's code, its error and that of its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded = codes.encode(rows, codes.fit(rows)).drop("embedding")
    return codes.with_group_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql(rounds: int = 6) -> str:
    """Rounds as one step after another; doubles hold these integers and their sums exactly."""
    near = """near{i} AS MATERIALIZED (
  SELECT p.vec_id, p.k, any_value(p.e) AS e, arg_min(b.j, (b.n - 2 * list_inner_product(p.e, b.e)) * 16 + b.j) AS j,
    any_value(p.n) + min(b.n - 2 * list_inner_product(p.e, b.e)) AS d
  FROM p JOIN book{i} b ON b.k = p.k GROUP BY p.vec_id, p.k)"""
    book = """sums{i} AS (
  SELECT k, j, place, floor(sum(c) / count(*)) AS c FROM (SELECT k, j, unnest(e) AS c, unnest(range(len(e))) AS place FROM near{i}) GROUP BY k, j, place),
new{i} AS (SELECT k, j, list(c ORDER BY place) AS e FROM sums{i} GROUP BY k, j),
book{n} AS MATERIALIZED (
  SELECT b.k, b.j, coalesce(new{i}.e, b.e) AS e, list_inner_product(coalesce(new{i}.e, b.e), coalesce(new{i}.e, b.e)) AS n
  FROM book{i} b LEFT JOIN new{i} ON new{i}.k = b.k AND new{i}.j = b.j)"""
    steps = [near.format(i=i) + ",\n" + book.format(i=i, n=i + 1) for i in range(rounds)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cuts AS (SELECT vec_id, k, e[CAST(k * len(e) // 8 + 1 AS BIGINT) : CAST((k + 1) * len(e) // 8 AS BIGINT)] AS e FROM v, (SELECT unnest(range(8)) AS k)),
p AS MATERIALIZED (SELECT *, list_inner_product(e, e) AS n FROM cuts),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v QUALIFY j < 16),
book0 AS MATERIALIZED (SELECT k, j, e, n FROM p JOIN seeds USING (vec_id)),
{(',' + chr(10)).join(steps)},
{near.format(i=rounds)},
digest AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY k, j, place)) AS codebooks_sha256
  FROM (SELECT k, j, unnest(e) AS c, unnest(range(len(e))) AS place FROM book{rounds})),
coded AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), digest
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat": op2_chat,
    "op3_decontamination": op3_decontamination,
    "op4_minhash": op4_minhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_embeddings": op7_embeddings,
    "op8_quality": op8_quality,
    "op9_html": op9_html,
    "op10_warc": op10_warc,
    "op11_negatives": op11_negatives,
    "op12_packing": op12_packing,
    "op13_codes": op13_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat": OP2_SQL,
    "op4_minhash": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_embeddings": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_negatives": OP11_SQL,
    "op13_codes": OP13_SQL,
}
