"""Queries of the operators of this package, each over its whole table, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import word_table
from touchline.llm.exact_topk import exact_topk
from touchline.llm.fill_middle import transformed
from touchline.llm.html_text import extract_pages
from touchline.llm.jaccard_join import jaccard_classes
from touchline.llm.language_id import identify_languages
from touchline.llm.merge_dropout import round_trips
from touchline.llm.merkle import verified
from touchline.llm.packing import pack_documents
from touchline.llm.permutation_index import nearest
from touchline.llm.quality import quality
from touchline.llm.secrets import secret_spans
from touchline.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector."""
    return exact_topk(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


ORACLES["op1_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by error-correcting output codes."""
    return identify_languages(_table(spark, sf_dir, "documents"))


@_query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by wrapper induction."""
    return extract_pages(_table(spark, sf_dir, "pages"))


@_query
def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded merge-dropout ids of every document, digested, and whether they decode to its text."""
    return round_trips(_table(spark, sf_dir, "documents"))


@_query
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found for every fiftieth vector by a permutation index."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@_query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by patterns and guess cost."""
    return secret_spans(_table(spark, sf_dir, "documents"))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by compiled rules."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier chain."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids by lexical neighbours."""
    return pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document (five words, Jaccard 0.75)."""
    return jaccard_classes(_table(spark, sf_dir, "documents"))


ORACLES["op10_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


@_query
def op11_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document through the table of distinct words, and the text decoded from them, as digests."""
    return word_table.round_trips(_table(spark, sf_dir, "documents"))


@_query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text restored from it, as digests."""
    return transformed(_table(spark, sf_dir, "documents"))


_LINES = r"regexp_extract_all(t, '[^\n]*\n|[^\n]+')"
ORACLES["op12_fill_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
  FROM documents
), l AS (SELECT doc_id, t, h, {_LINES} AS l, len({_LINES}) AS n FROM d
), c AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(l[1:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS p,
    array_to_string(l[least(h[1] % (n + 1), h[2] % (n + 1)) + 1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS m,
    array_to_string(l[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1:], '') AS s
  FROM l
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and checked proof of every document."""
    return verified(_table(spark, sf_dir, "documents"))


#: Unsigned crc32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""
_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
_ABOVE = "list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1:i + 8], '')))"
ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format("text")} AS leaf,
    {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low,
    doc_id IS NOT NULL AND crc32_of_id % 3 = 0 AS tampered
  FROM (SELECT *, {_CRC} AS crc32_of_id FROM documents)
), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), t(lang, level, l) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM i GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_ABOVE} FROM t WHERE len(l) > 1
), s AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(l) = 1
), u(level, l) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM s
  UNION ALL SELECT level + 1, {_ABOVE} FROM u WHERE len(l) > 1
), b AS (  -- one row per document and level with several nodes: its run and its slot there
  SELECT i.lang, i.pos, t.level AS level, t.l[(i.pos // CAST(8 ** level AS BIGINT)) // 8 * 8 + 1:(i.pos // CAST(8 ** level AS BIGINT)) // 8 * 8 + 8] AS run, (i.pos // CAST(8 ** level AS BIGINT)) % 8 + 1 AS slot
  FROM i JOIN t ON i.lang IS NOT DISTINCT FROM t.lang AND len(t.l) > 1
  UNION ALL SELECT i.lang, i.pos, 1000 + u.level, u.l[(s.pos // CAST(8 ** u.level AS BIGINT)) // 8 * 8 + 1:(s.pos // CAST(8 ** u.level AS BIGINT)) // 8 * 8 + 8], (s.pos // CAST(8 ** u.level AS BIGINT)) % 8 + 1
  FROM i JOIN s ON i.lang IS NOT DISTINCT FROM s.lang JOIN u ON len(u.l) > 1
), p AS (
  SELECT lang, pos, list({{'a': array_to_string(run[1:slot - 1], ''), 'b': array_to_string(run[slot + 1:], '')}} ORDER BY level) AS path FROM b GROUP BY lang, pos
)
SELECT i.doc_id, i.leaf, s.subroot, r.l[1] AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
  list_reduce(list_prepend({{'a': '', 'b': CASE WHEN tampered THEN low ELSE leaf END}}, coalesce(path, [])), lambda x, y: {{'a': '', 'b': sha256(y.a || x.b || y.b)}}).b AS folded_root,
  folded_root = r.l[1] AS verified
FROM i JOIN u r ON len(r.l) = 1 JOIN s ON i.lang IS NOT DISTINCT FROM s.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM i.lang AND p.pos = i.pos
"""
