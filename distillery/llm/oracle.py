"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from distillery.llm import filter_audit as audit
from distillery.llm import license_rules as lic
from distillery.llm import source_audit as src
from distillery.llm import url_rules as url


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licenses() -> str:
    entries = [(form, i) for i, forms in lic.SENTENCES.items() for form in forms]
    known = ", ".join(f"({_quoted(f)}, {_quoted(i)})" for f, i in entries)
    rules = ", ".join(f"({k}, {_quoted(r.license)}, [{', '.join(map(_quoted, r.sequence))}])" for k, r in enumerate(lic.RULES))
    return f"""
WITH known(form, id) AS (VALUES {known}),
rules(no, license, ids) AS (VALUES {rules}),
cut AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{lic.SENTENCE_END}') IF trim(x) <> ''] AS parts
  FROM documents),
sentences AS (
  SELECT r, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM cut),
found AS (
  SELECT r, pos, id, row_number() OVER (PARTITION BY r ORDER BY pos) AS k
  FROM (SELECT r, pos, trim(regexp_replace(regexp_replace(lower(s), '{lic.NOT_WORD}', ' \\1', 'g'), ' +', ' ', 'g')) AS form
        FROM sentences WHERE regexp_matches(lower(s), '{lic._cue(lic.SENTENCES)}')) JOIN known USING (form)),
seq AS (SELECT r, list(id ORDER BY pos) AS ids, list(pos ORDER BY pos) AS places FROM found GROUP BY r),
hits AS (
  SELECT f.r, u.no, u.license, min(f.pos) AS pos
  FROM found f JOIN seq USING (r) JOIN rules u
    ON list_slice(seq.ids, f.k, f.k + len(u.ids) - 1) = u.ids
   AND len([j FOR j IN range(1, len(u.ids)) IF seq.places[f.k + j] - seq.places[f.k + j - 1] > 2]) = 0
  GROUP BY ALL),
firsts AS (SELECT r, license, min(no) AS no, min(pos) AS pos FROM hits GROUP BY r, license),
per AS (SELECT r, string_agg(license, ' ' ORDER BY no) AS licenses, min(pos) AS first_sentence FROM firsts GROUP BY r)
SELECT doc_id, coalesce(array_to_string(seq.ids, ' '), '') AS sentence_ids, coalesce(licenses, '') AS licenses,
       CAST(first_sentence AS BIGINT) AS first_sentence
FROM cut LEFT JOIN seq USING (r) LEFT JOIN per USING (r)"""


def _urls() -> str:
    rules = ", ".join(f"({_quoted(r.name)}, {_quoted(r.verdict)}, {_quoted(r.host)}, {_quoted(r.path)})" for r in url.RULES)
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '^.*?://([^/?#]*)', 1, 's'), '{url._UPPER}', '{url._LOWER}')"
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    query = lambda u: f"regexp_extract(coalesce({u}, ''), '^.*?://[^?#]*(\\?[^#]*)', 1, 's')"
    dot = lambda x: f"regexp_replace({x}, '%2e', '.', 'gi')"

    def plain(p: str) -> str:
        """A path without its dot segments."""
        parts = f"str_split({p}, '/')"
        kept = (f"list_reduce(list_transform({parts}[2:], lambda s: [s]), lambda a, s: CASE {dot('s[1]')} WHEN '.' THEN a "
                f"WHEN '..' THEN a[:greatest(len(a) - 1, 0)] ELSE list_concat(a, s) END, CAST([] AS VARCHAR[]))")
        tail = f"CASE WHEN {dot(parts + '[-1]')} IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END"
        return (f"CASE WHEN regexp_matches({p}, '/(\\.|%2e){{1,2}}(/|$)', 'i') "
                f"THEN '/' || array_to_string({kept}, '/') || {tail} ELSE {p} END")

    def absolute(t: str, base: str) -> str:
        site = f"regexp_extract({base}, '^(.*?://[^/?#]*)', 1, 's')"
        folder = f"CASE WHEN contains({path(base)}, '/') THEN regexp_replace({path(base)}, '[^/]*$', '', 's') ELSE '/' END"
        return f"""CASE
    WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t}
    WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^(.*?)://', 1, 's') || ':' || {t}
    WHEN starts_with({t}, '/') THEN {site} || {t}
    WHEN regexp_matches({t}, '^[?#]') THEN {site} || {path(base)} || {t}
    ELSE {site} || {folder} || {t} END"""

    node = lambda u: f"{host(u)} || coalesce(nullif({plain(path(u))}, ''), '/') || {query(u)}"
    plain_amp = lambda x: f"regexp_replace({x}, '&(amp|#0*38|#x0*26);', '&', 'gi')"
    fits = "(t.host = r.host OR ends_with(t.host, '.' || r.host)) AND starts_with(t.path, r.path)"
    best = lambda t: (
        f"SELECT t.*, (SELECT struct_pack(rule := r.name, verdict := r.verdict) FROM rules r WHERE {fits} "
        f"ORDER BY length(r.name) DESC, length(r.host) DESC, r.verdict LIMIT 1) AS own FROM {t} t")
    return f"""
WITH RECURSIVE rules(name, verdict, host, path) AS (VALUES {rules}),
p AS (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
judged AS ({best('p')}),
named AS (
  SELECT url, node, {plain_amp("regexp_extract(coalesce(html, ''), '<base\\b[^>]*?\\bhref\\s*=\\s*[\"'']?\\s*([^\"''\\s>]+)', 1, 'i')")} AS b, unnest(
    [regexp_extract(x, '\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'i')
     FOR x IN regexp_extract_all(coalesce(html, ''), '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'i')]
    || [regexp_extract(x, ';\\s*url\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1, 'i')
        FOR x IN regexp_extract_all(coalesce(html, ''), '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'i')]) AS t
  FROM p WHERE host <> ''),
based AS (SELECT node, {plain_amp('t')} AS t, CASE WHEN b = '' THEN url ELSE coalesce({absolute('b', 'url')}, url) END AS base FROM named WHERE t <> ''),
full_links AS (SELECT node, {absolute('t', 'base')} AS target FROM based),
linked AS (
  SELECT node AS a, {node('target')} AS b, {host('target')} AS host, {plain(path('target'))} AS path
  FROM full_links WHERE target IS NOT NULL AND {host('target')} <> ''),
ends AS ({best('linked')}),
edges AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
verdicts AS (
  SELECT node, own.verdict AS v FROM judged WHERE host <> '' AND own IS NOT NULL
  UNION SELECT b, own.verdict FROM ends WHERE own IS NOT NULL),
spread AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM reach JOIN verdicts ON b = node GROUP BY a)
SELECT page_id, host, path, own.rule AS rule,
       coalesce(own.verdict, CASE WHEN host <> '' THEN spread.v END, 'allow') AS verdict
FROM judged LEFT JOIN spread ON spread.a = node"""


def _filter_steps() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(audit.FILTERS))
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
failed AS (
  SELECT part, doc_id IN (SELECT doc_id FROM good) AS good, doc_id IN (SELECT doc_id FROM toxic) AS toxic,
         concat(CASE WHEN len(w) < {audit.MIN_WORDS} THEN 'A' END,
                CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                CASE WHEN doc_id > first THEN 'E' END) AS fails
  FROM words JOIN firsts USING (t)),
orders(o) AS (VALUES {orders}),
places AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
cells AS (
  SELECT part, fails, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic
  FROM failed GROUP BY ALL),
hits AS (
  SELECT c.*, o, least({", ".join(f"coalesce(nullif(CASE WHEN contains(fails, '{f}') THEN position('{f}' IN o) ELSE 0 END, 0), 6)" for f in audit.FILTERS)}) AS place
  FROM cells c, orders),
steps AS (
  SELECT h.part, h.o AS filter_order, p.step, substr(h.o, p.step, 1) AS f,
         sum(CASE WHEN place > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN place < step AND contains(fails, substr(h.o, p.step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = substr(h.o, p.step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN place = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM hits h JOIN places p USING (o) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps"""


def _divergence() -> str:
    share = "1 + {s} * (CAST({c} AS HUGEINT) + 1) // ({n} + v)".replace("{s}", f"CAST({src.SCALE} AS HUGEINT)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {src.MIN_DOCS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS ns FROM counts GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share.format(c="coalesce(c.n, 0)", n="coalesce(ns, 0)")} AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, {share.format(c="n", n="nl")} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN (SELECT lang, sum(ns) AS nl FROM totals GROUP BY lang) USING (lang)
  JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
  FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= {src.TERM_RANKS}"""


ORACLE = {"op5_license_sentence_rules": _licenses(), "op10_redirect_equivalence": _urls(),
          "op12_removal_potential": _filter_steps(), "op13_run_length_divergence": _divergence()}
