"""The registered queries of this package: each applies one operator to a whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import fresh_folder
from . import (bpe, html_text, line_dedup, near_dedup, neighbours, packing, perplexity, substring_dedup, token_counts, toxicity, url_filter,
               vector_codes, whitening)
from .pretokens import added_tokens, library_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
END_OF_TEXT = 50256


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def english_pieces():
    """Ids as the tokenizer file gives them: a name that it adds, such as that of the end of a text, is one id wherever it stands."""
    return library_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def ordinary_pieces():
    """The same without added names: where the id of the end of a text separates documents, no text may hold it."""
    return library_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_digests(table(spark, sf, "documents"))


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), size=3, percent=85)


@query("op3_toxicity")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query("op4_perplexity_bands")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper")


@query("op5_nearest_vectors")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, sf, "embeddings"))
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all documents, read back from the flat files they are written to."""
    folder = fresh_folder(spark, "tokens")
    places = token_counts.write_token_files(table(spark, sf, "documents"), folder, ordinary_pieces, END_OF_TEXT)
    counts = token_counts.count_tokens(spark, folder, END_OF_TEXT)
    return places.join(counts.hint("merge"), ["file", "place"]).select("doc_id", "n_tokens")


# A window of two lines with words goes where it stands earlier too; documents without lines to remove keep their text.
LINES_SQL = r"""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS line FROM cut),
trimmed AS (SELECT *, regexp_replace(content, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t FROM lines),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM trimmed WHERE t <> ''),
pairs AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM solid),
numbered AS (SELECT *, row_number() OVER (PARTITION BY t, u ORDER BY doc_id, i) AS copy FROM pairs WHERE u IS NOT NULL),
later AS (SELECT doc_id, i FROM numbered WHERE copy > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (VALUES (0), (1)) v(d)),
marked AS (SELECT l.doc_id, l.content, l.line, g.i IS NOT NULL AS out FROM trimmed l LEFT JOIN solid s USING (doc_id, line) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed,
  sha256(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT out), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_sum_of_squares_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), english_pieces, 2)


@query("op9_main_text")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return html_text.extract(pages, html_text.fit(pages))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_qdwh_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.integer_rows(table(spark, sf, "embeddings"))
    return whitening.transform(rows, whitening.fit(rows))


def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds one after the other, every part against every entry; distance and index are one number, so that its minimum has the lower index."""
    nearest = """a{0} AS MATERIALIZED (SELECT r, p, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + e) AS best
  FROM parts JOIN b{0} USING (p) GROUP BY r, p)"""
    update = """s{0} AS (SELECT p, a.best % 16 AS e, i, sum(v[i]) AS s, count(*) AS n FROM a{1} a JOIN parts USING (r, p), range(1, 65) t(i) WHERE i <= len(v) GROUP BY ALL),
m{0} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{0} GROUP BY p, e),
b{0} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{1} b LEFT JOIN m{0} m USING (p, e))"""
    steps = []
    for turn in range(rounds):
        steps += [nearest.format(turn), update.format(turn + 1, turn)]
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
  list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT r, p, list_slice(x, p * (len(x) // 8) + 1, (p + 1) * (len(x) // 8)) AS v FROM kept, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 16),
{(","+chr(10)).join(steps)},
{nearest.format(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', CAST(best % 16 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
whole AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), whole"""


@query("op12_laesa_vector_codes", _codes_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.codes(vector_codes.integer_rows(table(spark, sf, "embeddings")))[0]


URL_RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
             url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]

# Edges by the canonical links and refreshes with absolute targets in double quotes; classes by reachability.
URL_SQL = r"""WITH RECURSIVE rules(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
edges AS (SELECT url AS source, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]+)"', 1) ||
  regexp_extract_all(html, '<meta http-equiv="refresh" content="\d+;\s*url=([^"]+)"', 1)) AS target FROM pages),
urls AS (SELECT url FROM pages UNION SELECT source FROM edges UNION SELECT target FROM edges),
cut AS (SELECT url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM urls),
named AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS node FROM cut),
ruled AS (SELECT n.url, n.host, n.path, n.node, r.rule, r.verdict FROM named n LEFT JOIN rules r
  ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) QUALIFY row_number() OVER (PARTITION BY n.url ORDER BY length(r.rule) DESC) = 1),
pairs AS (SELECT a.node AS a, b.node AS b FROM edges JOIN named a ON source = a.url JOIN named b ON target = b.url WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
reached(node) AS (SELECT node FROM ruled WHERE verdict = 'block' UNION
  SELECT CASE WHEN p.a = reached.node THEN p.b ELSE p.a END FROM reached JOIN pairs p ON reached.node IN (p.a, p.b)),
last AS (SELECT *, rule IS NULL AND coalesce(node IN (SELECT node FROM reached WHERE node IS NOT NULL), false) AS by_alias FROM ruled)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN by_alias THEN 'block' ELSE 'allow' END) AS verdict, by_alias
FROM pages JOIN last ON pages.url IS NOT DISTINCT FROM last.url"""


@query("op13_redirect_url_filter", URL_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)
