"""The registered queries of this package; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fingerprints, html_extract, line_templates, mixing, ngram_join, packing, quality_model, quality_rules, url_filter, warc

#: The rules that op6 judges by: verdict, host, path.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The path of the installed byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    rows = quality_model.score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"), keep=("doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken_words(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer or byte_bpe())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_rank")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_fingerprints": op10_fingerprints,
}

_OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (3 * source_size)::DOUBLE AS lim
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), picked AS (
  SELECT arg_min(level, (lim / weight, source IS NULL, source)) AS level FROM levels WHERE lim > level * weight
), targets AS (
  SELECT source, source_size, coalesce(least(picked.level * weight, lim), lim) AS target FROM levels, picked
), placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')),
           md5(coalesce(text, '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM sized
), queued AS (
  SELECT p.*, source_size, target, copy * source_size + start AS begin
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source, range(3) r(copy) WHERE size > 0
), items AS (
  SELECT *, least(step, size - part) AS words, (begin + part + least(step, size - part))::DOUBLE / target AS finish
  FROM (SELECT *, CASE WHEN serving THEN 16 ELSE size END AS step, unnest(CASE WHEN serving THEN range(0, size::BIGINT, 16) ELSE [0] END) AS part
        FROM (SELECT *, begin < target AND begin + size > target AS serving FROM queued))
), ordered AS (
  SELECT *, sum(words) OVER (ORDER BY finish, source NULLS LAST, begin + part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS before FROM items
), budget AS (
  SELECT sum(size) AS budget FROM sized
), served AS (
  SELECT source, start, sum(least(words, budget - before)) AS taken FROM ordered, budget WHERE before < budget GROUP BY ALL
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, coalesce(s.taken, 0)::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN served s ON s.source IS NOT DISTINCT FROM p.source AND s.start = p.start AND p.size > 0
"""

_CUTOFF_VALUES = ", ".join(f"('{r}', {c})" for r, grid in quality_rules.CUTOFFS.items() for c in grid)
_STRATUM = "CASE " + " ".join(f"WHEN n_words >= {b} THEN {i}" for i, b in reversed(list(enumerate(quality_rules.STRATA)))) + " END"
_LEVEL = quality_rules.FAILURE / (len(quality_rules.STRATA) * sum(map(len, quality_rules.CUTOFFS.values())))
_SHARE = quality_rules.FALSE_REJECTION / len(quality_rules.CUTOFFS)
_OP9 = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY doc_id
), base AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_STRATUM} AS stratum,
         MAP {{'symbols_per_word': n_symbols / greatest(n_words, 1), 'mean_word_chars': word_chars / greatest(n_words, 1),
              'repeat_share': n_repeat_words / greatest(n_words, 1), 'dup_line_share': n_dup_lines / greatest(n_lines, 1)}} AS metrics
  FROM base
), good AS (
  SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), cutoffs(rule, cutoff) AS (VALUES {_CUTOFF_VALUES}),
counts AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE metrics[rule] > cutoff) AS k
  FROM judged SEMI JOIN good USING (doc_id), cutoffs WHERE NOT base_failed GROUP BY ALL
), bounds AS (
  SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM counts WHERE k <= n * {_SHARE} AND k < n) GROUP BY ALL
), chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM bounds WHERE tail <= {_LEVEL} GROUP BY ALL
), rejected AS (
  SELECT DISTINCT doc_id FROM judged JOIN chosen USING (stratum) WHERE metrics[rule] > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected WHERE doc_id IS NOT NULL) AS kept
FROM judged
"""

_RULE_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _attribute(name: str) -> str:
    pattern = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return f"replace(regexp_replace({' || '.join(f"regexp_extract(tag, '{pattern}', {i})" for i in (1, 2, 3))}, '^\\s+|\\s+$', '', 'g'), '&amp;', '&')"


def _node(url: str) -> str:
    site, rest = f"regexp_extract({url}, '^[^/?#]*://[^/?#]*')", f"regexp_extract({url}, '^[^/?#]*://[^/?#]*([^#]*)', 1)"
    return (
        f"CASE WHEN {site} = '' THEN regexp_extract({url}, '^[^#]*') "
        f"ELSE translate({site}, '{_UPPER}', '{_LOWER}') || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END END"
    )


def _resolved(target: str, base: str) -> str:
    def dotless(path: str) -> str:
        merged = f"list_reduce(string_split({path}, '/')[2:], lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END, '')"
        return f"({merged} || CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END)"

    site, path, rest = f"regexp_extract({base}, '^[^/?#]*://[^/?#]*')", f"regexp_extract({target}, '^[^?#]*')", f"regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1)"
    own = f"regexp_extract({base}, '://[^/?#]*([^?#]*)', 1)"
    return f"""CASE WHEN starts_with({target}, '//') THEN regexp_extract({base}, '^([^/?#]*)://', 1) || ':' || {target}
      WHEN starts_with({target}, '/') THEN {site} || {dotless(path)} || {rest}
      WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains({target}, '://') THEN {target} END
      WHEN starts_with({target}, '?') THEN {site} || {own} || {target}
      WHEN {target} <> '' AND NOT starts_with({target}, '#') THEN {site} || {dotless(f"'/' || regexp_extract({own}, '^/(.*/)', 1) || {path}")} || {rest} END"""


_RULE_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_HIDDEN, _REFRESH = (x.replace("'", "''") for x in (url_filter.HIDDEN, url_filter.REFRESH))
_OP6 = rf"""
WITH RECURSIVE rules(what, rule_host, rule_path) AS (VALUES {_RULE_VALUES}),
shown AS (
  SELECT url, regexp_extract_all(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '(?is)<(?:link|meta|base)\b[^>]*>') AS tags FROM pages WHERE contains(url, '://')
), bases AS (
  SELECT url, tags, {_attribute("href")} AS given FROM (SELECT url, tags, coalesce(list_filter(tags, lambda x: regexp_matches(x, '(?i)^<base\b'))[1], '') AS tag FROM shown)
), tagged AS (
  SELECT url, coalesce({_resolved("given", "url")}, url) AS base, unnest(tags) AS tag FROM bases
), hrefs AS (
  SELECT url, base, CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND list_contains(regexp_split_to_array(lower({_attribute("rel")}), '\s+'), 'canonical')
      THEN {_attribute("href")}
    WHEN regexp_matches(tag, '(?i)^<meta\b') AND lower({_attribute("http-equiv")}) = 'refresh'
      THEN regexp_extract({_attribute("content")}, '{_REFRESH}', 1) END AS target FROM tagged
), targets AS (
  SELECT url, {_resolved("target", "base")} AS dst FROM hrefs WHERE target <> ''
), links AS (
  SELECT DISTINCT {_node("url")} AS src, {_node("dst")} AS dst FROM targets WHERE dst <> ''
), edges AS (
  SELECT src, dst FROM links WHERE dst <> '' UNION SELECT dst, src FROM links WHERE dst <> ''
), reach(node, other) AS (
  SELECT src, src FROM edges UNION SELECT r.node, e.dst FROM reach r JOIN edges e ON e.src = r.other
), parsed AS (
  SELECT u, coalesce(translate(regexp_extract(u, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT url AS u FROM pages UNION SELECT src FROM edges)
), fitting AS (
  SELECT u, arg_max((rule_host || rule_path, what), (length(rule_host || rule_path), what = 'allow')) AS best
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY u
), classes AS (
  SELECT r.node, bool_or(coalesce(f.best[2] = 'block', false)) AND NOT bool_or(coalesce(f.best[2] = 'allow', false)) AS blocked
  FROM reach r LEFT JOIN fitting f ON f.u = r.other GROUP BY r.node
)
SELECT page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, f.best[1] AS rule,
       coalesce(f.best[2], CASE WHEN c.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN parsed p ON p.u = url LEFT JOIN fitting f ON f.u = url LEFT JOIN classes c ON c.node = {_node("url")}
"""

_OP3 = r"""
WITH lines AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS l
  FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT doc_id, line, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS o FROM lines
), masked AS (
  SELECT *, len(o) AS n, list_transform(o, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM split WHERE len(o) > 0
), counted AS (
  SELECT *, len(list_filter(m, lambda x: x <> '<*>')) AS k, len(list_filter(o, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS digits FROM masked
), tokens AS (
  SELECT doc_id, line, n, own, CASE WHEN own THEN o ELSE m END AS t FROM (SELECT *, digits AND (n < 5 OR k < 3 OR 2 * k < n) AS own FROM counted)
), seen AS (
  SELECT t, any_value(n) AS n, bool_or(own) AS own, min(doc_id) AS first, max(doc_id) AS last FROM tokens GROUP BY t
), leaves AS (
  SELECT n, t[1:3] AS p FROM seen WHERE n >= 10 AND NOT own GROUP BY ALL HAVING count(*) > 1 AND min(first) < max(first)
), branches AS (
  SELECT s.t, s.n, s.first, g, t[1:3] AS p, t[4 + ((s.n - 3) * g) // 5 : 3 + ((s.n - 3) * (g + 1)) // 5] AS field
  FROM seen s JOIN leaves l ON s.n = l.n AND s.t[1:3] = l.p, range(5) r(g) WHERE NOT own
), ranked AS (
  SELECT *, first_value(first) OVER w AS earliest, first_value(t) OVER w AS r FROM branches WINDOW w AS (PARTITION BY n, p, g, field ORDER BY first, md5(array_to_string(t, ' ')))
), compared AS (
  SELECT t, earliest, len(list_filter(range(1, n + 1), lambda i: t[i] <> '<*>' OR r[i] <> '<*>')) AS known,
         len(list_filter(range(1, n + 1), lambda i: t[i] = r[i] AND t[i] <> '<*>')) AS same FROM ranked WHERE earliest < first
), merged AS (
  SELECT t, min(earliest) AS earlier FROM compared WHERE 10 * same >= 8 * known GROUP BY t
), firsts AS (
  SELECT t, least(first, coalesce(earlier, first)) AS first FROM seen LEFT JOIN merged USING (t)
), hits AS (
  SELECT DISTINCT doc_id, line FROM tokens JOIN firsts USING (t) WHERE doc_id > first
), kept AS (
  SELECT l.doc_id, string_agg(l.l, chr(10) ORDER BY l.line) FILTER (WHERE h.line IS NULL) AS text,
         count(*) AS n_lines, count(h.line) AS n_dropped
  FROM lines l LEFT JOIN hits h ON h.doc_id = l.doc_id AND h.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_OP7 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM split)
), sizes AS (
  SELECT doc_id, count(s.shingle) AS n FROM documents LEFT JOIN shingles s USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, other) AS (
  SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other
), least_of AS (
  SELECT node, min(other) AS component FROM reach GROUP BY node
)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM sizes LEFT JOIN least_of ON node = doc_id
"""

_OP8 = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         regexp_replace(regexp_extract(coalesce(url, ''), '^[^#]*'), '^[^:/?#]*://', '') AS place FROM pages
), keyed AS (
  SELECT page_id, payload, payload_bytes, array_to_string(list_reverse(string_split(lower(regexp_extract(place, '^[^/?]*')), '.')), ',') || ')/' ||
         CASE WHEN regexp_matches(place, '^[^/?]*\?') THEN regexp_replace(place, '^[^/]*/?', '') || regexp_extract(place, '\?[^/]*')
              ELSE regexp_replace(place, '^[^/]*/?', '') END AS url_key,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM payloads
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, row_number() OVER (ORDER BY url_key, captured, page_id NULLS LAST) AS capture_rank FROM keyed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to, url_key, captured, capture_rank
FROM firsts
"""

ORACLES: dict[str, str] = {
    "op3_line_dedup": _OP3,
    "op4_mixing": _OP4,
    "op6_url_filter": _OP6,
    "op7_ngram_join": _OP7,
    "op8_warc": _OP8,
    "op9_quality_rules": _OP9,
}
