"""DuckDB SQL for the queries, written apart from the Spark plans."""

from __future__ import annotations

from corvane.functions import lexicon as lex
from corvane.operators.grounding import GROUNDED_PROMPT, PLAIN_PROMPT

from .queries import EYEBALL, GOLD, HEADING, KEYWORDS, MARKERS, SOURCES, STATUTE, SUBJECT


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_s(w) for w in words) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def toks(x: str) -> str:
    found = rf"regexp_extract_all(translate(lower(coalesce({x}, '')), 'ı', 'i'), '[\p{{L}}\p{{N}}_]+')"
    return f"list_filter({found}, lambda w: length(w) > 2 AND NOT list_contains({_list(lex.STOP_WORDS)}, w))"


def sents(x: str) -> str:
    cut = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def chunks(x: str, most: int = 1200, overlap: int = 150, least: int = 200) -> str:
    empty = "{'done': []::VARCHAR[], 'open': ''}"
    pack = (
        f"list_reduce({sents('p')}, lambda a, s: CASE WHEN a.open = '' THEN {{'done': a.done, 'open': s}} "
        f"WHEN length(a.open) + length(s) + 1 <= {most} THEN {{'done': a.done, 'open': a.open || ' ' || s}} "
        f"ELSE {{'done': list_append(a.done, a.open), 'open': s}} END, {empty})"
    )
    paras = rf"list_filter(list_transform(string_split(regexp_replace(coalesce({x}, ''), '\n\s*\n+', chr(2), 'g'), chr(2)), lambda p: {strip('p')}), lambda p: p <> '')"
    pieces = f"flatten(list_transform({paras}, lambda p: CASE WHEN length(p) <= {most} THEN [p] ELSE list_transform([{pack}], lambda r: CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END)[1] END))"
    closed = f"CASE WHEN length(a.open) >= {least} THEN list_append(a.done, a.open) ELSE a.done END"
    fold = (
        f"list_reduce({pieces}, lambda a, p: CASE WHEN a.open = '' THEN {{'done': a.done, 'open': p}} "
        f"WHEN length(a.open) + length(p) + 2 <= {most} THEN {{'done': a.done, 'open': a.open || chr(10) || chr(10) || p}} "
        f"ELSE {{'done': {closed}, 'open': CASE WHEN length(a.open) > {overlap} THEN {strip(f'right(a.open, {overlap}) || chr(10) || chr(10) || p')} ELSE p END}} END, {empty})"
    )
    return f"list_transform([{fold}], lambda a: CASE WHEN a.open <> '' THEN {closed} ELSE a.done END)[1]"


def passages(key: str = "doc_id", source: str = "documents", text: str = "text") -> str:
    return f"""cut AS (SELECT {key}, {chunks(text)} AS c FROM {source}),
passages AS (SELECT {key}, (i - 1)::INTEGER AS chunk_idx, len(c)::INTEGER AS n_chunks, c[i] AS text
  FROM (SELECT {key}, c, unnest(generate_series(1, len(c))) AS i FROM cut WHERE len(c) > 0))"""


def bm25(did: str = "doc_id", corpus: str = "documents") -> str:
    """CTEs up to ``scored`` (qid, did, score) for the benchmark items."""
    return f"""dt AS (SELECT {did} AS did, {toks("text")} AS t FROM {corpus}),
n AS (SELECT count(*) AS n, sum(len(t)) / count(*)::DOUBLE AS avgdl FROM dt),
tf AS (SELECT did, len(t) AS dl, tok, count(*) AS tf FROM (SELECT did, t, unnest(t) AS tok FROM dt) GROUP BY ALL),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
raw AS (SELECT tok, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM df, n),
idf AS (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT qid, tok, count(*) AS qf FROM (SELECT item_id AS qid, unnest({toks("text")}) AS tok FROM benchmark) GROUP BY ALL),
scored AS (SELECT qid, did, round(sum(qf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM qt JOIN idf USING (tok) JOIN tf USING (tok), n GROUP BY qid, did)"""


def ranked(k: int, name: str = "sparse", source: str = "scored") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INTEGER AS rank FROM {source} WHERE score > 0) WHERE rank <= {k})"


_DOT = "round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6)"


def vectors(k: int, name: str = "dense") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INTEGER AS rank
  FROM (SELECT q.vec_id AS qid, d.vec_id AS did, {_DOT} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)) WHERE rank <= {k})"""


def item_vectors(k: int, name: str = "dense") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INTEGER AS rank
  FROM (SELECT q.vec_id AS qid, d.vec_id AS did, {_DOT} AS score FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= {k})"""


def fused(top_k: int = 10, fetch_k: int = 30) -> str:
    """CTEs up to ``fused`` (qid, did, score, dense_score, dense_rank, bm25_rank, pos), from ``fetch_k`` results of each list."""
    return f"""{bm25()}, {ranked(fetch_k)}, {item_vectors(fetch_k)},
both_lists AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.did, b.did) AS did, coalesce(a.score, 0e0) AS dense_score, a.rank - 1 AS dense_rank, b.rank - 1 AS bm25_rank,
  round(coalesce(1e0 / (60 + a.rank), 0e0) + coalesce(1e0 / (60 + b.rank), 0e0), 12) AS score
  FROM dense a FULL JOIN sparse b ON a.qid = b.qid AND a.did = b.did),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(dense_rank, 1073741824 + bm25_rank))::INTEGER AS pos FROM both_lists) WHERE pos <= {top_k})"""


QRELS = "qrels AS (SELECT b.item_id AS qid, d.doc_id AS did, 1 AS rel FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def judged(run: str, name: str) -> str:
    """CTE ``name`` of the judged metrics of a run CTE; needs qrels."""
    hits = ", ".join(f"max(CASE WHEN rel > 0 AND rank <= {k} THEN 1 ELSE 0 END) AS hit_{k}" for k in (1, 5, 10, 100))
    return f"""{name}_ideal AS (SELECT qid, sum(CASE WHEN i <= 10 THEN (2e0 ** rel - 1) / log2(i + 1) END) AS ideal, sum((rel > 0)::INTEGER) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, did) AS i FROM qrels) GROUP BY qid),
{name}_hits AS (SELECT r.qid, r.rank, coalesce(q.rel, 0) AS rel, sum((coalesce(q.rel, 0) > 0)::INTEGER) OVER (PARTITION BY r.qid ORDER BY r.rank) AS so_far
  FROM {run} r LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did),
{name}_per AS (SELECT qid, {hits}, 1e0 / min(CASE WHEN rel > 0 AND rank <= 10 THEN rank END) AS rr,
  sum(CASE WHEN rank <= 10 THEN (2e0 ** rel - 1) / log2(rank + 1) END) AS dcg, sum(CASE WHEN rel > 0 THEN so_far / rank::DOUBLE END) AS ap FROM {name}_hits GROUP BY qid),
{name} AS (SELECT i.qid, {", ".join(f"coalesce(hit_{k}, 0)::INTEGER AS hit_{k}" for k in (1, 5, 10, 100))}, round(coalesce(rr, 0e0), 6) AS mrr_10,
  round(coalesce(dcg, 0e0) / CASE WHEN ideal > 0 THEN ideal ELSE 1e0 END, 6) AS ndcg_10, round(CASE WHEN relevant > 0 THEN coalesce(ap, 0e0) / relevant ELSE 0e0 END, 6) AS map
  FROM {name}_ideal i LEFT JOIN {name}_per p USING (qid) WHERE i.qid IN (SELECT item_id FROM benchmark))"""


BOTH = f"{bm25()}, {ranked(100)}, {item_vectors(100)}, {QRELS}, {judged('sparse', 'ja')}, {judged('dense', 'jb')}"
ONE = f"{bm25()}, {ranked(100)}, {QRELS}, {judged('sparse', 'ja')}"
NAMES = ("hit_1", "hit_5", "hit_10", "hit_100", "mrr_10", "ndcg_10", "map")


def mean_of(names, by: str = "") -> str:
    return "count(*) AS n, " + ", ".join(f"sum(round(coalesce({c}, 0) * 1000000)::BIGINT)::BIGINT / (count(*) * 1000000)::DOUBLE AS {c}" for c in names)


def self_ideal(ks) -> str:
    """Metrics of ``run`` (qid, rank, rel) against its own best order."""
    places = ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= {k} THEN rel END DESC NULLS LAST, rank) AS i{k}" for k in ks)
    gain = lambda k, at: f"sum(CASE WHEN rank <= {k} THEN (2e0 ** rel - 1) / log2({at} + 1) END)"
    best = lambda k: f"CASE WHEN {gain(k, f'i{k}')} > 0 THEN {gain(k, f'i{k}')} ELSE 1e0 END"
    cols = ", ".join(f"max(CASE WHEN rel > 0 AND rank <= {k} THEN 1 ELSE 0 END)::INTEGER AS hit_{k}" for k in ks)
    ndcg = ", ".join(f"round({gain(k, 'rank')} / {best(k)}, 6) AS ndcg_{k}" for k in ks)
    return f"SELECT qid, {cols}, round(coalesce(1e0 / min(CASE WHEN rel > 0 THEN rank END), 0e0), 6) AS mrr, {ndcg} FROM (SELECT *, {places} FROM run) GROUP BY qid"


def resampled(values: str, resamples: int = 10_000) -> str:
    """CTEs up to ``means`` (b, m) from a CTE ``values`` (qid, v)."""
    return f"""num AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, round(v * 1000000)::BIGINT AS u FROM {values}),
size AS (SELECT count(*) AS n FROM num),
draws AS (SELECT b, ('0x' || substr(md5(b || '|' || k), 1, 8))::BIGINT % n AS i FROM range({resamples}) r(b), (SELECT unnest(range(n)) AS k, n FROM size)),
means AS (SELECT b, sum(u) / (1000000e0 * (SELECT n FROM size)) AS m FROM draws JOIN num USING (i) GROUP BY b)"""


def norm_query(x: str) -> str:
    return strip(squeeze(f"lower(translate(replace({x}, 'i̇', 'i'), 'İIıâîû', 'iiiaiu'))"))


def norm_keyword(x: str) -> str:
    return squeeze(rf"""regexp_replace(lower({x}), '[.,;:!?"''()\[\]/—–\-]', ' ', 'g')""")


def norm_graded(x: str) -> str:
    return f"translate(lower({x}), 'ıâ', 'ia')"


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def metadata(x: str) -> str:
    return rf"(regexp_matches({x}, '\b[ek]\.\s*\d+') OR regexp_matches({x}, '^[\d/.\s-]+$'))"


def bad(x: str) -> str:
    q, w = norm_query(x), words(norm_query(x))
    normed = lambda ws: f"list_transform({_list(ws)}, lambda z: {norm_query('z')})"
    return rf"""(list_contains({normed(lex.STOP_QUERIES)}, {q}) OR (len({w}) >= 4 AND 2 * len(list_filter({w}, lambda z: length(z) = 1)) >= len({w})) OR {metadata(q)}
 OR regexp_matches({q}, '^(madde|md|m)\.?\s*\d+$') OR len({w}) < 2 OR list_contains({normed(lex.GENERIC_QUERIES)}, {q})
 OR len(list_filter({w}, lambda z: NOT list_contains({normed(lex.GENERIC_QUERIES)}, z))) = 0)"""


def statutes(x: str) -> str:
    found = f"list_transform(regexp_extract_all(coalesce({x}, ''), {_s(STATUTE)}), lambda z: {strip('z')})"
    return f"list_filter({found}, lambda z, i: list_position({found}, z) = i)[1:20]"


def passage_of(x: str, markers) -> str:
    when = " ".join(f"WHEN instr({x}, {_s(m)}) BETWEEN 1 AND 1500 THEN instr({x}, {_s(m)})" for m in markers)
    return strip(f"substr({x}, CASE {when} ELSE 1 END, 2000)")


def candidates() -> str:
    """CTEs up to ``silver`` (qid, did, text, type) of documents."""
    head, subject = "substr(coalesce(text, ''), 1, 800)", SUBJECT
    return rf"""parts AS (SELECT doc_id, {strip(f"regexp_extract({head}, {_s(subject)}, 1)")} AS line,
  list_transform(regexp_extract_all({head}, {_s(HEADING)}, 1), lambda z: {strip('z')}) AS caps, {statutes('text')}[1:2] AS cited FROM documents),
cand AS (SELECT doc_id, 0 AS g, 0 AS i, line AS raw, substr(line, 1, 120) AS text, 'semantic' AS type FROM parts WHERE line <> ''
  UNION ALL SELECT doc_id, 1, i, caps[i], substr(lower(caps[i]), 1, 120), 'semantic' FROM (SELECT doc_id, caps, unnest(generate_series(1, len(caps))) AS i FROM parts)
  UNION ALL SELECT doc_id, 2, i, cited[i], substr(cited[i], 1, 120), 'lexical' FROM (SELECT doc_id, cited, unnest(generate_series(1, len(cited))) AS i FROM parts)),
good AS (SELECT *, {norm_query('text')} AS key FROM cand WHERE NOT {bad('raw')}),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY g, i) AS r FROM good) WHERE r = 1),
silver AS (SELECT 'q' || doc_id || '_' || (j - 1) AS qid, 'd' || doc_id AS did, text, type
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('d' || doc_id || '|' || text || '|42'), text, type) AS j FROM uniq) WHERE j <= 2)"""


SPECS = "specs AS (SELECT unnest([" + ", ".join(f"{{'qid': {_s(q)}, 'groups': [{', '.join(_list(g) for g in groups)}]}}" for q, groups in KEYWORDS) + "], recursive := false) AS s)"
KEYWORD_HIT = f"len(list_filter(s.groups, lambda g: len(list_filter(g, lambda t: contains(doc, {norm_keyword('t')}))) = len(g))) > 0"
GRADED_AT = f"list_position(list_transform(s.groups, lambda g: len(list_filter(g, lambda t: contains(doc, {norm_graded('t')}))) = len(g)), true)"

LABELS = "MAP {" + ", ".join(f"{_s(k)}: {_s(v)}" for k, v in SOURCES.items()) + "}"


def clean_html(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<![^>]*>', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
    for entity, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = f"replace({t}, {_s(entity)}, {_s(char)})"
    t = rf"regexp_replace({t}, '\s+\n', chr(10), 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(rf"regexp_replace({t}, '[ \t]+', ' ', 'g')")


def clean_markdown(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g')"
    return strip(rf"regexp_replace(regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")


def from_last(x: str, markers) -> str:
    when = " ".join(f"WHEN contains({x}, {_s(m)}) THEN substr({x}, length({x}) - instr(reverse({x}), {_s(m[::-1])}) - {len(m) - 2}, 2000)" for m in markers)
    return f"CASE {when} ELSE '' END"


def snippet(x: str, t: str, size: int = 600) -> str:
    at = f"list_min(list_filter(list_transform({t}, lambda z: instr(lower({x}), z)), lambda p: p > 0))"
    start = f"greatest(0, {at} - 101)"
    end = f"least(length({x}), {start} + {size})"
    cut = f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || substr({x}, {start} + 1, {end} - {start}) || CASE WHEN {end} < length({x}) THEN '...' ELSE '' END)"
    return f"CASE WHEN {at} IS NULL THEN substr({x}, 1, {size}) || CASE WHEN length({x}) > {size} THEN '...' ELSE '' END ELSE {cut} END"


RESULTS = f"""{fused()}, results AS (SELECT f.*, d.text, d.source AS kurul, d.doc_id::VARCHAR AS esas_no, d.n_chars::VARCHAR AS karar_no, {statutes('d.text')} AS kanunlar
  FROM fused f JOIN documents d ON f.did = d.doc_id)"""
CONTEXT = rf"""{RESULTS}, ctx AS (SELECT qid, string_agg(CASE WHEN pos <= 5 THEN '[Karar ' || pos || '] (' || coalesce(kurul, '?') || ' E.' || esas_no || '/K.' || coalesce(karar_no, '?') || ')' || chr(10) || {strip(squeeze("substr(coalesce(text, ''), 1, 800)"))} END, chr(10) || chr(10) ORDER BY pos) AS context, count(*) AS n_docs FROM results GROUP BY qid)"""
QA = """qa AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') || ' [Karar 1] [Karar 7] [Karar 1]' AS answer, u.text AS question, a.conv_id || '_' || a.turn AS qid
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"""
SPLIT = """split AS (SELECT doc_id, CASE WHEN r <= floor(n * 0.8e0) THEN 'train' WHEN r <= floor(n * 0.8e0) + floor(n * 0.1e0) THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)))"""
HITS = f"hits AS (SELECT s.qid, s.did, s.rank, b.text AS query, d.text FROM sparse s JOIN benchmark b ON s.qid = b.item_id JOIN documents d ON s.did = d.doc_id)"
NEGATIVES = """mined AS (SELECT qid, pos AS positive_id, list(did ORDER BY rank) AS ids FROM (
  SELECT p.qid, p.pos, r.did, r.rank, row_number() OVER (PARTITION BY p.qid, p.pos ORDER BY r.rank) AS i FROM pairs p JOIN run r ON p.qid = r.qid AND r.did <> p.pos WHERE r.rank > 2 AND r.rank <= 30 AND r.score < {ceiling}) WHERE i <= 4 GROUP BY qid, pos)"""
LEVEL = lambda i: "CASE WHEN dense_score >= 0.3e0 + 0.2e0 THEN {} WHEN dense_score >= 0.3e0 + 0.08e0 THEN {} ELSE {} END".format(*[_s(x[i]) for x in lex.LEVELS])
VERDICTS = " UNION ALL ".join(f"SELECT qid, pos * 100 + {i} AS pos, {_s(k)} AS name FROM results WHERE regexp_matches(lower(coalesce(text, '')), {_s(p)})" for i, (k, p) in enumerate(lex.VERDICTS.items()))
SUMMARY = f"""{RESULTS}, res AS (SELECT qid, pos, coalesce(kurul, '?') AS kurul FROM results),
boards AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, f, kurul) AS place FROM (SELECT qid, kurul, count(*) AS c, min(pos) AS f FROM res GROUP BY qid, kurul)),
verdicts AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, f, name) AS place FROM (SELECT qid, name, count(*) AS c, min(pos) AS f FROM ({VERDICTS}) GROUP BY qid, name)),
laws AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, f, name) AS place FROM (SELECT qid, name, count(*) AS c, min(pos * 100 + i - 1) AS f
  FROM (SELECT qid, pos, kanunlar[i] AS name, i FROM (SELECT qid, pos, kanunlar, unnest(generate_series(1, len(kanunlar))) AS i FROM results)) GROUP BY qid, name)),
summary AS (SELECT w.qid, w.n_results, b.kurul AS board, b.c AS board_count, w.n_boards, coalesce(v.x, '') AS verdicts, coalesce(l.x, '') AS statutes
  FROM (SELECT qid, count(*) AS n_results, count(DISTINCT kurul) AS n_boards FROM res GROUP BY qid) w JOIN boards b ON w.qid = b.qid AND b.place = 1
  LEFT JOIN (SELECT qid, string_agg(name || ' (' || c || ')', ' · ' ORDER BY place) AS x FROM verdicts WHERE place <= 3 GROUP BY qid) v ON w.qid = v.qid
  LEFT JOIN (SELECT qid, string_agg(name, '; ' ORDER BY place) AS x FROM laws WHERE place <= 2 GROUP BY qid) l ON w.qid = l.qid)"""

def training_pairs() -> str:
    allowed = lambda q: f"(NOT list_contains({_list(lex.TRAINING_STOP_QUERIES)}, {q}) AND NOT {metadata(q)})"
    head = "substr(text, 1, 600)"
    caps = f"list_filter(list_transform(regexp_extract_all({head}, {_s(HEADING)}, 1), lambda z: lower({strip('z')})), lambda z: length(z) > 8 AND length(z) < 100 AND len({words('z')}) >= 2 AND {allowed('z')})"
    line = f"list_filter([substr(lower({strip(f'regexp_extract({head}, {_s(SUBJECT)}, 1)')}), 1, 80)], lambda z: z <> '' AND {allowed('z')})"
    bare = " AND ".join(f"NOT contains(lower(z), {_s(w)})" for w in ("i̇çtihat", "mahkemesi", "esas"))
    fallback = f"list_transform(list_filter({sents('substr(text, 1, 1500)')}, lambda z: length(z) > 40 AND length(z) < 200 AND NOT {metadata('lower(z)')} AND {bare} AND NOT contains(string_split(lower(z), ' ')[1], 'karar'))[1:1], lambda z: substr(lower(z), 1, 180))"
    return f"""WITH dec AS (SELECT doc_id AS karar_id, text, list_filter(list_concat({caps}, {line}, list_transform({statutes('text')}[1:2], lambda z: lower(z))), lambda z: length(z) > 8 AND length(z) < 200) AS q
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE length(text) >= 800),
asked AS (SELECT karar_id, text, CASE WHEN len(q) = 0 THEN {fallback} ELSE list_filter(q, lambda z, i: list_position(q, z) = i)[1:3] END AS q FROM dec),
cut AS (SELECT karar_id, q, list_filter({chunks('text', 1200, 100)}, lambda z: length(z) >= 400) AS c FROM asked WHERE len(q) > 0),
pairs AS (SELECT karar_id, unnest(q) AS query, c FROM cut WHERE len(c) > 0),
picked AS (SELECT karar_id, query, c[('0x' || substr(md5(karar_id || '|' || query || '|42'), 1, 8))::BIGINT % len(c) + 1] AS passage FROM pairs)
SELECT karar_id, query, length(passage)::INTEGER AS size, md5(passage) AS digest FROM picked"""


def fused_of(k: int, top_k: int) -> str:
    """CTE ``wide``: the fusion of the CTEs dense100 and sparse100, lists of ``k``."""
    return f"""wide AS (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, turn)::INTEGER AS rank FROM (
  SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.did, b.did) AS did, coalesce(a.rank - 1, 1073741824 + b.rank - 1) AS turn, round(coalesce(1e0 / (60 + a.rank), 0e0) + coalesce(1e0 / (60 + b.rank), 0e0), 12) AS score
  FROM dense{k} a FULL JOIN sparse{k} b ON a.qid = b.qid AND a.did = b.did) QUALIFY rank <= {top_k})"""


def bm25_of(queries: str) -> str:
    """The CTEs of ``bm25`` with other queries than the benchmark's: a CTE (qid, query)."""
    return bm25().replace(f"SELECT item_id AS qid, unnest({toks('text')}) AS tok FROM benchmark", f"SELECT qid, unnest({toks('query')}) AS tok FROM {queries}")


def pairs_table(rows) -> str:
    return "(VALUES " + ", ".join(f"({_s(q)}, {_s(t)})" for q, t in rows) + ") v(qid, query)"


def paired(metric: str, name: str) -> str:
    """CTE ``name`` (d, p, lo, hi): the paired bootstrap of a metric of ja and jb."""
    return f"""{name}_v AS MATERIALIZED (SELECT qid, ja.{metric} - jb.{metric} AS v FROM ja JOIN jb USING (qid)), {_renamed(resampled(f"{name}_v"), name)},
{name} AS (SELECT round(d, 6) AS d, round(least(1e0, 2e0 * CASE WHEN d >= 0 THEN count(*) FILTER (m <= 0) ELSE count(*) FILTER (m >= 0) END / count(*)), 6) AS p,
  round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM {name}_means, (SELECT avg(v) AS d FROM {name}_v) GROUP BY d)"""


def interval(run: str, metric: str, name: str) -> str:
    """CTE ``name`` (mean, lo, hi): the bootstrap interval of a metric."""
    return f"""{name}_v AS MATERIALIZED (SELECT qid, {metric} AS v FROM {run}), {_renamed(resampled(f"{name}_v"), name)},
{name} AS (SELECT round((SELECT avg(v) FROM {name}_v), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM {name}_means)"""


def _renamed(ctes: str, name: str) -> str:
    for cte in ("num", "size", "draws", "means"):
        ctes = ctes.replace(f"{cte} AS (", f"{name}_{cte} AS (").replace(f"FROM {cte}", f"FROM {name}_{cte}").replace(f"JOIN {cte} ", f"JOIN {name}_{cte} ")
    return ctes


STARS = "CASE WHEN p IS NULL THEN '' WHEN p < 0.001e0 THEN '***' WHEN p < 0.01e0 THEN '**' WHEN p < 0.05e0 THEN '*' ELSE 'ns' END"
RUN100 = f"{bm25()}, {ranked(100, 'sparse100')}, {item_vectors(100, 'dense100')}, {QRELS}"
DRESSED = "SELECT r.qid, r.did, r.rank, b.text AS query, d.text, coalesce(q.rel, 0) AS rel FROM {} r JOIN benchmark b ON r.qid = b.item_id JOIN documents d ON r.did = d.doc_id LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did"


def matrix_of(name: str, run: str) -> str:
    """CTEs of the plain and the reranked metrics of a run of 100."""
    again = f"""{name}_s AS (SELECT qid, did, rank AS was, rel, list_distinct({toks('query')}) AS w, {toks('substr(text, 1, 1500)')} AS t FROM {name}_d WHERE rank <= 15),
{name}_o AS (SELECT qid, did, was, rel, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda z: list_contains(t, z))) / len(w)::DOUBLE ELSE 0e0 END, 6) AS score FROM {name}_s),
{name}_r AS (SELECT * FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was, did)::INTEGER AS rank FROM {name}_o) WHERE rank <= 10)"""
    metrics = lambda source: self_ideal((1, 3, 5, 10)).replace("FROM run)", f"FROM {source})")
    return f"{name}_d AS ({DRESSED.format(run)}), {name}_p AS (SELECT * FROM {name}_d WHERE rank <= 10), {again}, {name}_mp AS ({metrics(f'{name}_p')}), {name}_mr AS ({metrics(f'{name}_r')})"


KEYWORD_NAMES = ("hit_1", "hit_3", "hit_5", "hit_10", "mrr", "ndcg_1", "ndcg_3", "ndcg_5", "ndcg_10")
GOLD_SPECS = "gold AS MATERIALIZED (SELECT s.qid AS qid, s.query AS query, s.rel AS rel FROM (SELECT unnest([" + ", ".join(f"{{'qid': {_s(q)}, 'query': {_s(t)}, 'rel': [{', '.join(_list(g) for g in r)}]}}" for q, t, r in GOLD) + "], recursive := false) AS s))"
#: The two-sided tail of Student's distribution for whole degrees of freedom: a finite sum of cosines.
TAIL = """angle AS (SELECT t, df, atan(abs(t) / sqrt(df)) AS a FROM stat),
terms AS (SELECT t, df, a, list_reduce(range((df % 2) + 2, df - 1, 2), lambda s, j: {'last': s.last * (j - 1) / j * cos(a) * cos(a), 'all': s.all + s.last * (j - 1) / j * cos(a) * cos(a)},
  {'last': CASE WHEN df % 2 = 1 THEN cos(a) ELSE 1e0 END, 'all': CASE WHEN df % 2 = 1 THEN cos(a) ELSE 1e0 END}) AS s FROM angle)"""


WHOLE = f"""{passages()}, firsts AS (SELECT doc_id, text, min(chunk_idx) AS i FROM passages GROUP BY doc_id, text), whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS t FROM firsts GROUP BY doc_id)"""

LOADED = f"""SELECT page_id::VARCHAR AS karar_id, nullif(url, '') AS kurul, '' AS hukum, {strip("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  length(t)::INTEGER AS size, md5(t) AS digest FROM (SELECT *, {clean_html('html')} AS t FROM pages) WHERE length(t) >= 500"""

ORACLE_SQL = {
    "training_pairs": training_pairs(),
    "training_batches": f"""WITH tp AS ({training_pairs()}), counts AS (SELECT karar_id, count(*) AS n FROM tp GROUP BY karar_id),
b AS (SELECT greatest(ceil(sum(n) / 32e0)::BIGINT, max(n), 1) AS b FROM counts),
placed AS (SELECT karar_id, query, row_number() OVER (PARTITION BY karar_id ORDER BY md5(query || '|42')) - 1 AS j FROM tp)
SELECT karar_id, md5(query) AS query, (('0x' || substr(md5(karar_id || '|42'), 1, 7))::BIGINT + j) % b AS batch FROM placed, b""",
    "prompts": f"""WITH {CONTEXT} SELECT b.item_id AS qid, md5(replace(replace({_s(GROUNDED_PROMPT)}, '{{question}}', b.text), '{{context}}', coalesce(context, ''))) AS grounded,
  md5(replace({_s(PLAIN_PROMPT)}, '{{question}}', b.text)) AS plain FROM benchmark b LEFT JOIN ctx ON b.item_id = ctx.qid""",
    "tokenize": f"SELECT doc_id, (i - 1)::INTEGER AS pos, t[i] AS tok FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, {toks('text')} AS t FROM documents))",
    "df_idf": f"WITH {bm25()} SELECT tok, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {bm25()}, {ranked(10)} SELECT qid, did, score, rank FROM sparse",
    "bm25_pruned": f"WITH {bm25()}, {ranked(10)} SELECT qid, did, score, rank FROM sparse",
    "streamed_bm25": f"WITH live AS (SELECT * FROM documents WHERE doc_id % 97 <> 1), {bm25('doc_id', 'live')}, {ranked(10)} SELECT qid, did, score, rank FROM sparse",
    "bm25_run_padded": f"""WITH {bm25()}, every AS (SELECT q.qid, d.did, coalesce(s.score, 0e0) AS score FROM (SELECT DISTINCT qid FROM qt) q CROSS JOIN dt d LEFT JOIN scored s ON s.qid = q.qid AND s.did = d.did)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INTEGER AS rank FROM every) WHERE rank <= 100""",
    "dense_one_scan": f"WITH {vectors(10)} SELECT qid, did, score, rank FROM dense",
    "dense_topk": f"WITH {vectors(10)} SELECT qid, did, score, rank FROM dense",
    "hybrid_rrf": f"WITH {fused()} SELECT qid, did, pos, round(score, 9) AS score, dense_score, dense_rank::INTEGER AS dense_rank, bm25_rank::INTEGER AS bm25_rank FROM fused",
    "dedupe_best_chunk": f"""WITH {passages()}, pd AS (SELECT doc_id * 100000 + chunk_idx AS did, text FROM passages), {bm25("did", "pd")}, {ranked(200)},
best AS (SELECT *, did // 100000 AS doc_id, row_number() OVER (PARTITION BY qid, did // 100000 ORDER BY rank) AS f FROM sparse)
SELECT qid, doc_id, did, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS pos FROM best WHERE f = 1) WHERE pos <= 10""",
    "near_dup_first": r"SELECT substr(regexp_replace(lower(substr(coalesce(text, ''), 1, 120)), '[^\p{L}\p{N}_]', '', 'g'), 1, 80) AS signature, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "chunk_records": f"WITH {passages()} SELECT doc_id, chunk_idx, n_chunks, length(text)::INTEGER AS size, md5(text) AS digest FROM passages",
    "clean_html": f"SELECT page_id, length(t)::INTEGER AS size, md5(t) AS digest FROM (SELECT page_id, {clean_html('html')} AS t FROM pages)",
    "extract_sections": rf"""SELECT page_id, {strip("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  array_to_string(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<li[^>]*>(.*?)</li>', 1), lambda z: {strip(squeeze("regexp_replace(z, '(?s)<[^>]*>', ' ', 'g')"))}), lambda z: regexp_matches(z, '^[A-Z]'))[1:20], '|') AS items,
  md5(body) AS body_digest, {from_last('body', ["zzz", "The ", "La "])} AS conclusion
FROM (SELECT *, CASE WHEN contains(t, '</p>') THEN substr(t, instr(t, '</p>') + 4) ELSE t END AS body FROM (SELECT *, {clean_html('html')} AS t FROM pages))""",
    "load_json_decisions": LOADED,
    "json_array_stream": LOADED,
    "clean_markdown": f"SELECT doc_id, length(t)::INTEGER AS size, md5(t) AS digest FROM (SELECT doc_id, {clean_markdown('text')} AS t FROM documents)",
    "extract_statutes": f"SELECT doc_id, (i - 1)::INTEGER AS pos, s[i] AS statute FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, {statutes('text')} AS s FROM documents))",
    "load_filter_truncate": rf"""SELECT doc_id::VARCHAR AS karar_id, n_chars::VARCHAR AS esas_no, lang AS tarih, coalesce(nullif(source, ''), 'Bilinmeyen') AS kurul, source AS source_label,
  coalesce(nullif(source, ''), 'Bilinmeyen') || ' - E. ' || coalesce(n_chars::VARCHAR, 'None') || ', K. None' AS title, '' AS konu, length(t)::INTEGER AS size, md5(t) AS digest
FROM (SELECT *, substr(m, 1, 15000) AS t FROM (SELECT *, {clean_markdown('text')} AS m FROM documents) WHERE length(m) >= 500)""",
    "load_counts": f"""SELECT unnest(['seen', 'kept', 'short', 'cut']) AS name, unnest([count(*), count(*) FILTER (n >= 500), count(*) FILTER (n < 500), count(*) FILTER (n > 15000)]) AS n
FROM (SELECT length({clean_markdown('text')}) AS n FROM documents)""",
    "informative_passage": f"SELECT doc_id, length(t)::INTEGER AS size, md5(t) AS digest FROM (SELECT doc_id, {passage_of('x', MARKERS)} AS t FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))",
    "source_labels": f"SELECT coalesce({LABELS}[source], source) AS label, count(*) AS n FROM documents GROUP BY 1",
    "silver_queries": f"WITH {candidates()} SELECT qid, did, text, type FROM silver",
    "silver_stats": f"""WITH {candidates()} SELECT 'corpus' AS name, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'queries', count(DISTINCT qid) FROM silver
UNION ALL SELECT 'qrels', count(*) FROM silver UNION ALL SELECT 'type_' || type, count(*) FROM silver GROUP BY type""",
    "bad_queries": f"""SELECT id, kind, n, {bad('q')} AS bad, {metadata('lower(q)')} AS metadata FROM (
SELECT doc_id AS id, 'words' AS kind, (k - 1)::INTEGER AS n, array_to_string(w[1:k], ' ') AS q FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest([1, 2, 3]) AS k FROM documents)
UNION ALL SELECT doc_id, 'line', 0, string_split(text, chr(10))[1] FROM documents UNION ALL SELECT item_id, 'item', 0, text FROM benchmark)""",
    "text_norms": f"SELECT doc_id, md5({norm_keyword('t')}) AS keyword, md5({norm_graded('t')}) AS graded, md5({norm_query('t')}) AS query, array_to_string(list_filter({sents('t')}, lambda s: length(s) > 30)[1:3], ' ') AS summary FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "split_80_10_10": f"WITH {SPLIT} SELECT doc_id, split FROM split",
    "split_disjoint": f"WITH {SPLIT} SELECT count(*) AS overlaps FROM (SELECT doc_id FROM split GROUP BY doc_id HAVING count(DISTINCT split) > 1)",
    "gold_template": f"""WITH {QRELS}, picked AS (SELECT item_id, text FROM benchmark ORDER BY md5(item_id || '|42'), item_id::VARCHAR LIMIT 150)
SELECT p.item_id::VARCHAR AS query_id, p.text AS query_text, 'semantic' AS query_type, q.did::VARCHAR AS candidate_doc_id, coalesce(d.source, '') AS candidate_title,
  replace(substr(coalesce(d.text, ''), 1, 300), chr(10), ' ') AS candidate_excerpt, '' AS relevance_0_1_2 FROM picked p JOIN qrels q ON p.item_id = q.qid LEFT JOIN documents d ON q.did = d.doc_id""",
    "keyword_relevance": f"WITH {SPECS} SELECT s.qid AS qid, lang, sum(({KEYWORD_HIT})::INTEGER)::BIGINT AS n_relevant FROM (SELECT lang, {norm_keyword('text')} AS doc FROM documents), specs GROUP BY ALL",
    "graded_relevance": f"WITH {SPECS} SELECT s.qid AS qid, CASE WHEN {GRADED_AT} = 1 THEN 2 WHEN {GRADED_AT} > 1 THEN 1 ELSE 0 END AS grade, count(*) AS n FROM (SELECT {norm_graded('text')} AS doc FROM documents), specs GROUP BY ALL",
    "metrics_qrels": f"WITH {ONE} SELECT * FROM ja",
    "metrics_mean": f"WITH {ONE} SELECT {mean_of(NAMES)} FROM ja",
    "metrics_keyword": f"WITH {vectors(10)}, run AS (SELECT r.qid, r.rank, (d.label = q.label)::INTEGER AS rel FROM dense r JOIN embeddings d ON r.did = d.vec_id JOIN embeddings q ON r.qid = q.vec_id) {self_ideal((1, 3, 5, 10))}",
    "metrics_gold": f"WITH {vectors(10)}, run AS (SELECT r.qid, r.rank, CASE WHEN d.label = q.label THEN 2 WHEN abs(d.label - q.label) = 1 THEN 1 ELSE 0 END AS rel FROM dense r JOIN embeddings d ON r.did = d.vec_id JOIN embeddings q ON r.qid = q.vec_id) {self_ideal((1, 5, 10))}",
    "suite_means": f"""WITH {fused(100, 100)}, hy AS (SELECT qid, did, pos AS rank FROM fused), {QRELS}, {judged("sparse", "ja")}, {judged("dense", "jb")}, {judged("hy", "jc")}
SELECT system, {mean_of(NAMES)} FROM (SELECT 'bm25' AS system, * FROM ja UNION ALL SELECT 'dense', * FROM jb UNION ALL SELECT 'hybrid', * FROM jc) GROUP BY system""",
    "error_pivot": f"""WITH {BOTH}, won AS (SELECT ja.qid, CASE WHEN ja.hit_10 > jb.hit_10 THEN 'bm25' WHEN jb.hit_10 > ja.hit_10 THEN 'dense' ELSE 'tie' END AS w FROM ja JOIN jb USING (qid))
SELECT CASE WHEN length(text) < 150 THEN 'short' WHEN length(text) < 250 THEN 'middle' ELSE 'long' END AS type, count(*) FILTER (w = 'bm25') AS bm25, count(*) FILTER (w = 'dense') AS dense,
  count(*) FILTER (w = 'tie') AS tie, count(*) AS total FROM won JOIN benchmark ON qid = item_id GROUP BY 1""",
    "hard_neg_bm25": f"WITH {bm25()}, {ranked(30, 'run')}, {QRELS}, pairs AS (SELECT qid, did AS pos FROM qrels), {NEGATIVES.format(ceiling='1e300')} SELECT qid, positive_id, array_to_string(ids, ',') AS negative_ids FROM mined",
    "hard_neg_dense": f"WITH {vectors(30, 'run')}, pairs AS (SELECT qid, did AS pos FROM run WHERE rank = 3), {NEGATIVES.format(ceiling='0.6e0')} SELECT qid, positive_id, array_to_string(ids, ',') AS negative_ids FROM mined",
    "triplets": f"""WITH {bm25()}, {ranked(30, 'run')}, {QRELS}, pairs AS (SELECT qid, did AS pos FROM qrels), {NEGATIVES.format(ceiling='1e300')}, rows AS (SELECT qid, positive_id, unnest(ids) AS neg FROM mined)
SELECT md5('query: ' || b.text) AS anchor, md5('passage: ' || substr(p.text, 1, 1200)) AS positive, md5('passage: ' || substr(n.text, 1, 1200)) AS negative
FROM rows r JOIN benchmark b ON r.qid = b.item_id JOIN documents p ON r.positive_id = p.doc_id JOIN documents n ON r.neg = n.doc_id WHERE p.text <> '' AND n.text <> ''""",
    "bootstrap_ci": f"WITH {ONE}, vals AS (SELECT qid, ndcg_10 AS v FROM ja), {resampled('vals')} SELECT round((SELECT avg(v) FROM vals), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM means",
    "paired_bootstrap": f"""WITH {BOTH}, vals AS (SELECT qid, ja.mrr_10 - jb.mrr_10 AS v FROM ja JOIN jb USING (qid)), {resampled('vals')}, seen AS (SELECT avg(v) AS d FROM vals)
SELECT round(d, 6) AS diff_mean, round(least(1e0, 2e0 * CASE WHEN d >= 0 THEN count(*) FILTER (m <= 0) ELSE count(*) FILTER (m >= 0) END / count(*)), 6) AS p_value,
  round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM means, seen GROUP BY d""",
    "multi_seed": f"""WITH {ONE}, per AS (SELECT substr(md5(qid::VARCHAR), 1, 1) AS seed, avg(mrr_10) AS mrr_10, avg(map) AS map FROM ja GROUP BY 1)
SELECT 'mrr_10' AS metric, round(avg(mrr_10), 6) AS mean, round(stddev_pop(mrr_10), 6) AS std FROM per UNION ALL SELECT 'map', round(avg(map), 6), round(stddev_pop(map), 6) FROM per""",
    "abstain_rrf": f"""WITH {fused()}, t AS (SELECT qid, count(*) AS n, arg_min(score, pos) AS s FROM fused GROUP BY qid),
r AS (SELECT item_id AS qid, CASE WHEN coalesce(n, 0) < 1 THEN {_s(lex.TOO_FEW)} WHEN s < 0.02e0 THEN {_s(lex.TOO_WEAK)} END AS reason FROM benchmark LEFT JOIN t ON item_id = qid) SELECT qid, reason IS NOT NULL AS abstain, reason FROM r""",
    "abstain_cosine": f"WITH {fused()}, t AS (SELECT qid, arg_min(dense_score, pos) AS s FROM fused GROUP BY qid) SELECT item_id AS qid, coalesce(s, 0e0) < 0.3e0 AS abstain FROM benchmark LEFT JOIN t ON item_id = qid",
    "confidence": f"WITH {fused()} SELECT qid, did, {LEVEL(1)} AS level, {LEVEL(2)} AS color, {LEVEL(3)} AS dots FROM fused",
    "result_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "summary_html": f"""WITH {SUMMARY} SELECT qid, concat_ws('<br>', '<b>' || n_results || '</b> emsal ' || CASE WHEN board_count > 1 THEN 'çoğunlukla <b>' || board || '</b>' ELSE '<b>' || n_boards || ' farklı daireden</b>' END || ' geldi.',
  CASE WHEN verdicts <> '' THEN '<b>Hüküm dağılımı:</b> ' || verdicts END, CASE WHEN statutes <> '' THEN '<b>Sık atıf:</b> ' || statutes END) AS html FROM summary""",
    "full_text": f"WITH {WHOLE} SELECT doc_id, length(t)::INTEGER AS size, md5(t) AS digest FROM whole",
    "full_text_bucketed": f"WITH {WHOLE} SELECT doc_id, length(t)::INTEGER AS size, md5(t) AS digest FROM whole",
    "hit_texts_bucketed": f"WITH {WHOLE}, {bm25()}, {ranked(10)} SELECT qid, did, rank, length(t)::INTEGER AS size, md5(t) AS digest FROM sparse JOIN whole ON did = doc_id",
    "snippet": f"WITH {bm25()}, {ranked(10)}, {HITS} SELECT qid, did, {snippet('text', toks('query'))} AS snippet FROM hits",
    "context": f"WITH {CONTEXT} SELECT qid, context, n_docs FROM ctx",
    "citations": rf"""WITH {QA}, c AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(answer, '\[Karar\s+(\d+)\]', 1), lambda z: z::INTEGER)) AS c FROM qa), v AS (SELECT *, len(list_filter(c, lambda z: z BETWEEN 1 AND 3)) AS ok FROM c)
SELECT conv_id, turn, len(c)::INTEGER AS n_citations, ok::INTEGER AS valid_citations, CASE WHEN len(c) > 0 THEN round(ok / len(c)::DOUBLE, 6) END AS citation_validity FROM v""",
    "claims": f"WITH {QA}, c AS (SELECT conv_id, turn, list_filter({sents('answer')}, lambda s: length(s) > 15) AS c FROM qa) SELECT conv_id, turn, (i - 1)::INTEGER AS pos, c[i] AS claim FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM c)",
    "faithfulness": f"""WITH {QA}, c AS (SELECT qid, list_distinct({toks('question')}) AS p, list_filter({sents('answer')}, lambda s: length(s) > 15) AS c FROM qa),
e AS (SELECT qid, i, c[i] AS claim, p, list_distinct({toks('c[i]')}) AS w FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM c)),
s AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda z: list_contains(p, z))) / len(w)::DOUBLE ELSE 0e0 END >= 0.2e0 AS ok FROM e),
g AS (SELECT qid, count(*) FILTER (ok) AS ok, string_agg(claim, '|' ORDER BY i) FILTER (NOT ok) AS u FROM s GROUP BY qid)
SELECT qid, CASE WHEN len(c) > 0 THEN round(coalesce(ok, 0) / len(c)::DOUBLE, 6) END AS faithfulness, len(c)::INTEGER AS n_claims, coalesce(ok, 0) AS supported, coalesce(u, '') AS unsupported FROM c LEFT JOIN g USING (qid)""",
    "reranked": f"""WITH {bm25()}, {ranked(20)}, {HITS}, s AS (SELECT qid, did, rank AS was, list_distinct({toks('query')}) AS w, {toks('substr(text, 1, 1500)')} AS t FROM hits),
o AS (SELECT qid, did, was, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda z: list_contains(t, z))) / len(w)::DOUBLE ELSE 0e0 END, 6) AS score FROM s)
SELECT qid, did, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was, did)::INTEGER AS rank FROM o) WHERE rank <= 5""",
    "index_build": f"WITH {passages()} SELECT doc_id, chunk_idx, n_chunks, 64 AS width, CASE WHEN len({toks("'passage: ' || text")}) > 0 THEN 1e0 ELSE 0e0 END AS norm FROM passages",
    "markdown_answer": f"""WITH {RESULTS}, cards AS (SELECT qid, b.text AS query, count(*) AS n, string_agg(concat('---', chr(10), '**[', pos, '] ', coalesce(nullif(kurul, ''), 'Bilinmeyen Kurul'), ' — E. ', esas_no,
  ', K. ', coalesce(nullif(karar_no, ''), '?'), ' (?)**  ', chr(10), 'İlgili mevzuat: ', CASE WHEN len(kanunlar) > 0 THEN array_to_string(kanunlar[1:3], '; ') ELSE '—' END, '  ', chr(10), 'Skor: ', printf('%.3f', score), '  ',
  chr(10), chr(10), '> ', {strip(squeeze(snippet("coalesce(r.text, '')", toks("b.text"), 500)))}, chr(10)), chr(10) ORDER BY pos) AS body
  FROM results r JOIN benchmark b ON qid = item_id WHERE pos <= 5 GROUP BY qid, b.text)
SELECT item_id AS qid, CASE WHEN body IS NULL THEN {_s(lex.NO_ANSWER)} ELSE concat('### Sorgu', chr(10), '> ', query, chr(10), chr(10), '**Bulunan ', n, ' ilgili Yargıtay kararı:**', chr(10), chr(10), body,
  {_s(lex.ANSWER_NOTE)}) END AS answer FROM benchmark LEFT JOIN cards ON item_id = qid""",
    "index_stats": f"WITH {passages()} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM passages",
    "query_types": "SELECT coalesce(role, 'unknown') AS type, count(*) AS n FROM conversations GROUP BY 1",
    "mean_pooling": """WITH f AS (SELECT label, (i - 1)::INTEGER AS i, embedding[i]::DOUBLE AS x, CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE 1e0 END AS m FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
p AS (SELECT label, i, sum(x * m) / greatest(sum(m), 1e-9) AS v FROM f GROUP BY label, i)
SELECT label, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS x FROM p""",
    "paired_t": f"""WITH {BOTH}, vals AS (SELECT ja.mrr_10 - jb.mrr_10 AS v FROM ja JOIN jb USING (qid)), stat AS (SELECT CASE WHEN stddev_samp(v) > 0 THEN avg(v) / (stddev_samp(v) / sqrt(count(*))) END AS t, count(*) - 1 AS df FROM vals), {TAIL}
SELECT round(t, 6) AS t, df, round(1e0 - CASE WHEN df = 1 THEN a * 2e0 / pi() WHEN df % 2 = 1 THEN (a + sin(a) * s.all) * 2e0 / pi() ELSE sin(a) * s.all END, 6) AS p_value FROM terms""",
    "comparison_report": f"""WITH {BOTH}, {interval("ja", "mrr_10", "ia")}, {interval("jb", "mrr_10", "ib")}, {paired("mrr_10", "pt")}
SELECT printf('mrr_10:%s  %-28s %.3f  [%.3f, %.3f]%s  %-28s %.3f  [%.3f, %.3f]%s  Δ = %+.3f  (p=%.4f %s)', chr(10), 'bm25', ia.mean, ia.lo, ia.hi, chr(10), 'dense', ib.mean, ib.lo, ib.hi, chr(10), pt.d, pt.p, {STARS}) AS report FROM ia, ib, pt""",
    "significance_grid": f"""WITH {BOTH}, {paired("hit_10", "ph")}, {paired("map", "pm")}
SELECT 'bm25' AS a, 'dense' AS b, metric, d AS diff_mean, p AS p_value, {STARS} AS stars FROM (SELECT 'hit_10' AS metric, d, p FROM ph UNION ALL SELECT 'map', d, p FROM pm)""",
    "masked_mean_pooling": """WITH f AS (SELECT vec_id // 8 AS text_id, (i - 1)::INTEGER AS i, embedding[i]::DOUBLE AS x, CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE 1e0 END AS m FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
p AS (SELECT text_id, i, sum(x * m) / greatest(sum(m), 1e-9) AS v FROM f GROUP BY text_id, i), w AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY text_id)) AS size FROM p)
SELECT text_id, i, round(CASE WHEN size > 0 THEN v / size ELSE 0e0 END, 6) AS x FROM w""",
    "chunk_dense_run": f"""WITH {item_vectors(200)}, best AS (SELECT *, did // 4 AS doc, row_number() OVER (PARTITION BY qid, did // 4 ORDER BY rank) AS f FROM dense)
SELECT qid, doc, did, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS pos FROM best WHERE f = 1) WHERE pos <= 100""",
    "hybrid_grouped": f"""WITH {fused(1000000)}, best AS (SELECT f.*, doc_id // 4 AS "group", row_number() OVER (PARTITION BY qid, doc_id // 4 ORDER BY pos) AS f FROM fused f LEFT JOIN documents d ON f.did = d.doc_id)
SELECT qid, did, "group", p AS pos, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos)::INTEGER AS p FROM best WHERE f = 1) WHERE p <= 10""",
    "near_dup_results": rf"""WITH {RESULTS}, k AS (SELECT qid, did, pos, substr(regexp_replace(lower(substr(coalesce(text, ''), 1, 120)), '[^\p{{L}}\p{{N}}_]', '', 'g'), 1, 80) AS signature FROM results)
SELECT qid, did, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, signature ORDER BY pos) AS f FROM k) WHERE f = 1""",
    "config_matrix": f"""WITH {RUN100}, {fused_of(100, 100)}, {matrix_of("b", "sparse100")}, {matrix_of("d", "dense100")}, {matrix_of("h", "wide")}, every AS (SELECT 'bm25' AS config, * FROM b_mp UNION ALL SELECT 'bm25 + rerank', * FROM b_mr
UNION ALL SELECT 'dense', * FROM d_mp UNION ALL SELECT 'dense + rerank', * FROM d_mr UNION ALL SELECT 'hybrid', * FROM h_mp UNION ALL SELECT 'hybrid + rerank', * FROM h_mr) SELECT config, {mean_of(KEYWORD_NAMES)} FROM every GROUP BY config""",
    "gold_evaluation": f"""WITH {GOLD_SPECS}, {bm25_of("gold")}, {ranked(10)}, run AS (SELECT r.qid, r.rank, CASE WHEN place = 1 THEN 2 WHEN place > 1 THEN 1 ELSE 0 END AS rel FROM (
  SELECT sparse.qid, rank, list_position(list_transform(gold.rel, lambda g: len(list_filter(g, lambda t: contains({norm_graded("text")}, {norm_graded("t")}))) = len(g)), true) AS place FROM sparse JOIN gold USING (qid) JOIN documents ON did = doc_id) r),
per AS ({self_ideal((1, 5, 10))})
SELECT qid, {", ".join(f"coalesce({c}, 0)::INTEGER AS {c}" for c in ("hit_1", "hit_5", "hit_10"))}, {", ".join(f"coalesce({c}, 0e0) AS {c}" for c in ("mrr", "ndcg_1", "ndcg_5", "ndcg_10"))} FROM gold LEFT JOIN per USING (qid)""",
    "eyeball": f"""WITH eye AS (SELECT * FROM {pairs_table(EYEBALL)}), {bm25_of("eye")}, {ranked(5)}
SELECT qid, did, rank, round(score, 4) AS score, '[' || rank || '] ' || coalesce(source, '?') || ' | ' || replace(substr(coalesce(text, ''), 1, 200), chr(10), ' ') || '...' AS line FROM sparse JOIN documents ON did = doc_id""",
    "beir_round_trip": f"""WITH {candidates()} SELECT s.qid, s.did, 1 AS rel, s.type, s.text, '' AS title, md5({passage_of('x', MARKERS)}) AS digest FROM silver s JOIN (SELECT 'd' || doc_id AS d, coalesce(text, '') AS x FROM documents) ON s.did = d""",
    "index_round_trip": f"WITH {passages()} SELECT doc_id AS karar_id, chunk_idx, n_chunks, md5(text) AS digest, 64 AS width FROM passages",
    "results_round_trip": f"WITH {ONE}, m AS (SELECT {mean_of(NAMES)} FROM ja) SELECT 'bm25' AS config, metric, round(value, 3) AS value FROM (UNPIVOT (SELECT hit_1, hit_10, mrr_10, map FROM m) ON hit_1, hit_10, mrr_10, map INTO NAME metric VALUE value)",
    "comparison_table": f"""WITH {BOTH}, every AS (SELECT 'bm25' AS system, * FROM ja UNION ALL SELECT 'dense', * FROM jb), m AS (SELECT system, {mean_of(("hit_1", "hit_10", "mrr_10"))} FROM every GROUP BY system)
SELECT printf('%-28s %8.4f %8.4f %8.4f', system, hit_1, hit_10, mrr_10) AS line FROM m""",
    "winning_examples": f"WITH {BOTH} SELECT ja.qid, b.text AS query FROM ja JOIN jb USING (qid) JOIN benchmark b ON ja.qid = b.item_id WHERE ja.hit_10 > jb.hit_10 ORDER BY ja.qid LIMIT 15",
}
