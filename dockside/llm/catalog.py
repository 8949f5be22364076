"""Registered queries of this package, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockside.llm import (
    brown,
    conversations,
    decontaminate,
    fill_middle,
    html_extract,
    licenses,
    neighbours,
    packing,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; every node has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_html_extraction(spark, folder):
    """Main text of every page, found by the wrapper of its host.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``html_extract.extract_text``.
    """
    return html_extract.extract_text(read(spark, folder, "pages"))


def op2_packing(spark, folder):
    """Pieces of sequences of 2,048 tokens, every document's ids each in one piece.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``packing.pack``.
    """
    return packing.pack(read(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op3_decontamination(spark, folder):
    """How many words of every document stand in benchmark windows of 13 words.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``decontaminate.contamination``.
    """
    return decontaminate.contamination(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )


def op4_nearest(spark, folder):
    """The 20 nearest vectors of every twentieth one, by inner product; factor 1 is exact.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``neighbours.nearest``.
    """
    return neighbours.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_token_counts(spark, folder):
    """Bytes and tokens of every document, and whether these are more than 1,024.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``token_counts.token_counts``.
    """
    return token_counts.token_counts(
        read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json")
    )


def op6_substring_dedup(spark, folder):
    """Words of every document left after passages of 13 words that a smaller id has, too.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``substring_dedup.remove_repeats``.
    """
    return substring_dedup.remove_repeats(read(spark, folder, "documents"))


def op7_license_scan(spark, folder):
    """Licence phrases and labels of every document.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``licenses.scan_licenses``.
    """
    return licenses.scan_licenses(read(spark, folder, "documents"))


def op8_sharding(spark, folder):
    """Shard and place of every document under the ``rows`` law.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``sharding.shard_rows``.
    """
    sharded = sharding.shard_rows(read(spark, folder, "documents"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_toxicity(spark, folder):
    """Score of every document, learnt from labelled ones outside the held-out fifth.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``toxicity.fit`` and ``toxicity.score``.
    """
    docs = read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, folder, "labels")))


def op10_simhash(spark, folder):
    """Fingerprint and component of every document.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``simhash.near_duplicates``.
    """
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op11_class_scores(spark, folder):
    """Log probability of every document under a class-based model of six sevenths of them.

    NULLs, empty and long texts, ties, repeated rows and empty tables: see ``brown.class_model``.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return brown.class_model(read(spark, folder, "documents"), held_out).scores


def op12_fill_in_middle(spark, folder):
    """Fill-in-the-middle form of every document, as digests of the output and of the text in it.

    NULLs, empty and long texts, ties and repeated rows: see ``fill_middle.fill_in_middle``.
    """
    samples = fill_middle.fill_in_middle(read(spark, folder, "documents"))
    return samples.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored_text().cast("binary"), 256).alias("restored_sha256"),
    )


def op13_conversation_repair(spark, folder):
    """Faults and the cheapest repair of every damaged conversation, with a digest of the repaired turns.

    NULLs, long texts, ties, repeated rows and conversations without rows: see ``conversations.repair``.
    """
    pieces = conversations.repair_damaged(read(spark, folder, "conversations"))
    return conversations.digests(pieces)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_packing,
        op3_decontamination,
        op4_nearest,
        op5_token_counts,
        op6_substring_dedup,
        op7_license_scan,
        op8_sharding,
        op9_toxicity,
        op10_simhash,
        op11_class_scores,
        op12_fill_in_middle,
        op13_conversation_repair,
    )
}

# SQL of what SQL can express; tests compare the other queries with brute force.

_WORDS = r"""
  regexp_extract_all(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
"""

CONTAMINATION = f"""
  WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
  items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
  windows AS (
    SELECT DISTINCT item_id, LEAST(13, len(ws)) AS size,
      array_to_string(ws[i:i + LEAST(13, len(ws)) - 1], ' ') AS words
    FROM (SELECT *, unnest(range(1, GREATEST(2, len(ws) - 11))) AS i FROM items WHERE len(ws) > 0)),
  sizes AS (SELECT DISTINCT size FROM windows),
  places AS (
    SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS words
    FROM (
      SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
      FROM docs, sizes WHERE len(ws) >= size)),
  found AS (SELECT doc_id, size, i, item_id FROM places JOIN windows USING (size, words)),
  hits AS (
    SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (
      SELECT doc_id, unnest(range(i, i + size)) AS p
      FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY doc_id),
  named AS (
    SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
  SELECT doc_id, len(ws) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
    sha256(COALESCE(names, '')) AS items_sha256,
    COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(ws) AS contaminated
  FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

REPEATS = r"""
  WITH docs AS (
    SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS words
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs)),
  firsts AS (SELECT words, MIN(doc_id) AS first_id FROM windows GROUP BY words),
  gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
    FROM windows JOIN firsts USING (words) WHERE first_id < doc_id),
  placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM docs),
  kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, COUNT(*) AS n
    FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, len(ws) AS n_words, len(ws) - COALESCE(n, 0) AS n_removed,
    sha256(COALESCE(kept, '')) AS kept_sha256
  FROM docs LEFT JOIN kept USING (doc_id)"""

NEAREST = """
  WITH held AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x:
        x IS NULL OR isnan(x) OR isinf(x)), true)
      AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
  parts AS (
    SELECT q.vec_id AS query_id, b.vec_id AS vec_id,
      list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * b.e[i]),
        lambda s, x: s + x) AS score
    FROM held q JOIN held b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id AND len(q.e) = len(b.e)),
  ranked AS (
    SELECT query_id, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM parts)
  SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

FILL_IN_MIDDLE = r"""
  WITH cut AS (
    SELECT doc_id, COALESCE(text, '') AS text,
      regexp_extract_all(COALESCE(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
      sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  drawn AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
      CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS x,
      CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS chance,
      CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS way FROM cut),
  parts AS (
    SELECT doc_id, text, n,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR chance >= 90 THEN 'plain' WHEN way < 20 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(units[1:LEAST(x, y)], '') AS pre,
      array_to_string(units[LEAST(x, y) + 1:GREATEST(x, y)], '') AS mid,
      array_to_string(units[GREATEST(x, y) + 1:], '') AS suf FROM drawn),
  formed AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM parts)
  SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(output) AS output_sha256, sha256(pre || mid || suf) AS restored_sha256
  FROM formed"""

def _crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text, bit by bit."""
    # Fixed values: the polynomial, bits reversed, and the start.
    shifted = (
        "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    )
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    start = "CAST(4294967295 AS BIGINT)"
    return f"xor(list_reduce(list_prepend({start}, {codes}), lambda c, b: {shifted}), {start})"


# Ways over a row: state before, inserted turns, state at the row's own edit.
_WAYS = ", ".join(
    f"({e}, '{'I' * k}', {s}, {5 * k})"
    for e, chain in ((0, (0, 2, 3)), (1, (1, 2, 3)), (2, (2, 3, 2)), (3, (3, 2, 3)))
    for k, s in enumerate(chain)
)

CONVERSATION_REPAIR = rf"""
  WITH RECURSIVE given AS (
    SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
      {_crc32("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")}
        % 20 AS kind FROM conversations),
  damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM given WHERE kind <> 0),
  placed AS (
    SELECT *, rtrim(text, E' 	

') AS body,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
  judged AS (
    SELECT *, substr(role, 1, 1) AS initial,
      CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END
        AS fault FROM placed),
  paired AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged),
  told AS (
    SELECT conv_id, COUNT(*) AS n,
      COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
      COUNT(*) FILTER (fault = 1) AS blank, COUNT(*) FILTER (fault = 2) AS duplicate,
      COUNT(*) FILTER (fault = 3) AS truncated,
      COUNT(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM paired GROUP BY conv_id),
  ways(e, ins, s, paid) AS (VALUES {_WAYS}),
  steps AS (
    SELECT j.conv_id, j.i, w.e,
      CASE WHEN k.edit = 'D' THEN w.s WHEN k.edit = 'R' THEN CASE w.s WHEN 2 THEN 3 ELSE 2 END
        ELSE CASE j.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS x,
      CAST(w.paid + CASE k.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN k.edit <> 'D' AND j.fault = 3 THEN 5 ELSE 0 END AS BIGINT) AS cost,
      w.ins || k.edit AS edits,
      list_transform(range(length(w.ins)), lambda t: CASE (w.e = 2) = (t % 2 = 0) WHEN true THEN 'assistant:' ELSE 'user:' END)
        || CASE k.edit WHEN 'D' THEN CAST([] AS VARCHAR[])
          WHEN 'K' THEN [j.role || ':' || j.text]
          ELSE [CASE w.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || j.text] END AS written
    FROM judged j, ways w, (VALUES ('D'), ('R'), ('K')) k(edit)
    WHERE k.edit = 'D' OR j.fault IN (0, 3) AND (k.edit = 'R' OR
      (j.initial = 's' AND w.s = 0) OR (j.initial = 'u' AND w.s IN (0, 1, 3)) OR (j.initial = 'a' AND w.s = 2))),
  walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS x,
      {{'cost': CAST(0 AS BIGINT), 'audit': '', 'written': CAST([] AS VARCHAR[])}} AS best
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, x, best FROM (
      SELECT w.conv_id, s.i, s.x, MIN({{'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.edits,
        'written': w.best.written || s.written}}) AS best
      FROM walk w JOIN steps s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = w.i + 1 AND s.e = w.x
      GROUP BY w.conv_id, s.i, s.x)),
  ended AS (
    SELECT w.conv_id, MIN({{
      'cost': w.best.cost + CASE w.x WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END,
      'audit': w.best.audit || CASE w.x WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
      'written': w.best.written || CASE w.x WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:']
        ELSE CAST([] AS VARCHAR[]) END}}) AS best, any_value(t.gaps) AS gaps, any_value(t.blank) AS blank,
      any_value(t.duplicate) AS duplicate, any_value(t.truncated) AS truncated, any_value(t.illegal) AS illegal
    FROM walk w LEFT JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id
    WHERE w.i = COALESCE(t.n, 0) GROUP BY w.conv_id)
  SELECT conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
    COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
    sha256(array_to_string(best.written, chr(10))) AS repaired_sha256
  FROM ended"""

ORACLE_SQL: dict[str, str] = {
    "op13_conversation_repair": CONVERSATION_REPAIR,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op3_decontamination": CONTAMINATION,
    "op4_nearest": NEAREST,
    "op6_substring_dedup": REPEATS,
}
