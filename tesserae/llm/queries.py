"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat, flac, mixing, ngram_join, pii, quality, suffix_dedup, token_counts, toxicity
from .common import table


def op1_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit_labels(docs, table(spark, sf_dir, "labels")))


def op4_suffix_array(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark, sf_dir):
    """All conversations as logs of streamed, edited and regenerated messages, folded, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    one = spark.range(1).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r"),
    )
    rows = rows.unionByName(one.select("conv_id", "r.turn", "r.role", "r.text"))
    return chat.digests(chat.read_back(chat.render(chat.reconstruct(chat.streamed(rows)))))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_byte_bpe(spark, sf_dir):
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    """Every document with three edits: words put in the middle, the first five characters cut, the last one replaced."""
    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    place = lambda seq, start, end, new: F.struct(F.lit(seq).cast("long").alias("seq"), start.alias("start"), end.alias("end"), F.lit(new).alias("replacement"))
    middle = F.floor(n / 2)
    edits = F.array(place(0, middle, middle, " an inserted clause,"), place(1, F.lit(0).cast("long"), F.lit(5).cast("long"), ""), place(2, n + 14, n + 15, "!\n"))
    return token_counts.count_tokens(docs.select("doc_id", "text", edits.alias("edits")), edits_col="edits")


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_labels(docs, table(spark, sf_dir, "labels")))


def op10_flac(spark, sf_dir):
    return flac.media_column(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_ngram_join, op3_quality_rules, op4_suffix_array, op5_chat_formatting, op6_source_mixing, op7_byte_bpe, op8_token_counts, op9_toxicity, op10_flac)}
#: The other queries hold trained models, suffix arrays and hashes, encoders or Newton's method, which SQL does not
#: express; tests/llm hold them against brute force. That of op2 makes all pairs with a common shingle: for small tables.
ORACLE_SQL = {
    "op2_ngram_join": r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS own FROM w),
    e AS (SELECT r, len(own) AS n, hash(unnest(own)) AS token FROM s),
    p AS (SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.token = b.token AND a.r < b.r AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
    c AS (SELECT r, r AS reached FROM s UNION SELECT c.r, l.y FROM c JOIN l ON c.reached = l.x)
    SELECT s.doc_id, any_value(len(s.own))::BIGINT AS n_shingles, min(t.doc_id) AS component_id FROM s JOIN c USING (r) JOIN s t ON t.r = c.reached GROUP BY s.r, s.doc_id""",
    "op5_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(9 + length(regexp_replace(role, '[\\<\[\]]', 'xx', 'g')) + length(regexp_replace(text, '[\\<\[\]]', 'xx', 'g')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
}
