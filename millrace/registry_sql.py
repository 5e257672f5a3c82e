"""DuckDB SQL of the retrieval queries, put together from shared parts."""

from __future__ import annotations

from millrace.operators.chunking import SEPARATORS
from millrace.operators.grounding import ABSTAIN, WARNING

TOKENS = "greatest(1, length({0}) // 4)"
WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _text(x: str) -> str:
    return " || ".join("chr(10)" if part == "\n" else "'" + part.replace("'", "''") + "'" for part in _lines(x)) or "''"


def _lines(x: str) -> list[str]:
    out: list[str] = []
    for i, part in enumerate(x.split("\n")):
        out += ["\n"] * (i > 0) + [part] * bool(part)
    return out


def _level(n: int, sep: str, budget: int) -> str:
    quoted = _text(sep)
    longer = f"(CASE WHEN acc.buf = '' THEN x.buf ELSE acc.buf || {quoted} || x.buf END)"
    step = (
        f"CASE WHEN {TOKENS.format(longer)} <= {budget} THEN {{'out': acc.out, 'buf': {longer}}} "
        "ELSE {'out': list_concat(acc.out, list_filter([acc.buf, x.buf], lambda z: z <> '')), 'buf': ''} END"
    )
    start = "{'out': []::VARCHAR[], 'buf': ''}"
    packed = f"list_reduce(list_transform(string_split(p, {quoted}), lambda y: {{'out': []::VARCHAR[], 'buf': y}}), lambda acc, x: {step}, {start})"
    closed = f"list_transform([{packed}], lambda r: list_concat(r.out, list_filter([r.buf], lambda z: z <> '')))[1]"
    return f"l{n + 1} AS (SELECT doc_id, source, flatten(list_transform(ps, lambda p: CASE WHEN {TOKENS.format('p')} <= {budget} THEN [p] ELSE {closed} END)) AS ps FROM l{n})"


def chunks(budget: int = 400, overlap: int = 80) -> str:
    """CTEs that end in ``ch``: chunk_id, doc_id, source, pos, text."""
    levels = ["l0 AS (SELECT doc_id, source, [coalesce(text, '')] AS ps FROM documents)"]
    levels += [_level(n, sep, budget) for n, sep in enumerate(SEPARATORS)]
    last = len(SEPARATORS)
    step = 3 * budget
    hard = f"list_transform(range(0, length(p), {step}), lambda i: substr(p, i::INT + 1, {step}))"
    levels.append(f"hs AS (SELECT doc_id, source, list_filter(flatten(list_transform(ps, lambda p: CASE WHEN {TOKENS.format('p')} <= {budget} THEN [p] ELSE {hard} END)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS ps FROM l{last})")
    carried = f"CASE WHEN {TOKENS.format('a[-1]')} > {overlap} THEN right(a[-1], {4 * overlap}) || chr(10) || x[1] ELSE x[1] END"
    fold = f"list_reduce(list_transform(ps, lambda p: [p]), lambda a, x: list_append(a, {carried}))"
    strip = "regexp_replace(m, '^\\s+|\\s+$', '', 'g')"
    levels.append(f"ov AS (SELECT doc_id, source, CASE WHEN len(ps) <= 1 THEN ps ELSE list_filter(list_transform({fold}, lambda m: {strip}), lambda m: m <> '') END AS ps FROM hs)")
    levels.append("ex AS (SELECT doc_id, source, unnest(range(len(ps))) AS pos, unnest(ps) AS text FROM ov)")
    levels.append("ch AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, * FROM ex)")
    return "WITH " + ",\n".join(levels)


STATS = f"""WITH tok AS (SELECT doc_id AS chunk_id, source, text, {WORDS} AS tokens FROM documents),
dl AS (SELECT chunk_id, len(tokens) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i0 AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf0 FROM df, st),
idf AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25::DOUBLE * (SELECT avg(idf0) FROM i0) END AS idf FROM i0)"""

LEXICAL = f"""{STATS},
qt AS (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark),
qf AS (SELECT query_id, term, count(*) AS qf FROM qt GROUP BY ALL),
bs AS (SELECT query_id, chunk_id, round(sum(qf * (idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 4) AS score
       FROM qf JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id),
b AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank, chunk_id, score FROM bs WHERE score > 0 QUALIFY rank < 20)"""

BUCKET = "('0x' || substr(md5(term), 1, 8))::BIGINT % 64"
DENSE = f"""hv AS (SELECT chunk_id, {BUCKET} AS bucket, sum(tf)::DOUBLE AS c FROM tf GROUP BY ALL),
qv AS (SELECT query_id, {BUCKET} AS bucket, sum(qf)::DOUBLE AS c FROM qf GROUP BY ALL),
hn AS (SELECT chunk_id, sqrt(sum(c * c)) AS size FROM hv GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(c * c)) AS size FROM qv GROUP BY ALL),
dots AS (SELECT query_id, chunk_id, sum(qv.c * hv.c) AS dot FROM qv JOIN hv USING (bucket) GROUP BY ALL),
vs AS (SELECT q.item_id AS query_id, tok.chunk_id, round(coalesce(dot / (qn.size * hn.size), 0), 6) AS score
       FROM benchmark q CROSS JOIN tok LEFT JOIN dots ON dots.query_id = q.item_id AND dots.chunk_id = tok.chunk_id
       LEFT JOIN qn ON qn.query_id = q.item_id LEFT JOIN hn ON hn.chunk_id = tok.chunk_id),
v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank, chunk_id, score FROM vs QUALIFY rank < 20)"""
FUSED = f"""{LEXICAL}, {DENSE},
fu AS (SELECT query_id, chunk_id, coalesce(1::DOUBLE / (60 + v.rank + 1), 0) + coalesce(1::DOUBLE / (60 + b.rank + 1), 0) AS score,
              v.rank AS vr, b.rank AS br, round(coalesce(v.score, 0), 4) AS vector_score, round(coalesce(b.score, 0), 4) AS bm25_score
       FROM v FULL JOIN b USING (query_id, chunk_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr ASC NULLS LAST, br ASC NULLS LAST) - 1 AS fused_rank FROM fu)"""
HITS = f"""{FUSED},
h AS (SELECT query_id, fused_rank AS rank, f.chunk_id, source, text, score, vector_score, bm25_score FROM f JOIN tok USING (chunk_id) WHERE fused_rank < 6)"""
MERGED = f"""{HITS},
mg AS (SELECT query_id % 10 AS group_id, chunk_id, max(score) AS score, arg_min(source, query_id * 1000000 + rank) AS source,
              arg_min(vector_score, query_id * 1000000 + rank) AS vector_score, min(query_id * 1000000 + rank) AS seen FROM h GROUP BY 1, 2)"""
JUDGED = f"""{HITS},
got AS (SELECT query_id, list(source ORDER BY rank) AS retrieved FROM h GROUP BY query_id),
rel AS (SELECT q.item_id AS query_id, list(DISTINCT d.source) AS relevant FROM benchmark q JOIN documents d ON contains(d.text, q.text) AND d.source IS NOT NULL GROUP BY 1),
ev AS (SELECT query_id, relevant, retrieved, len(relevant) AS n,
              list_min(list_filter(list_transform(retrieved, lambda x, i: CASE WHEN list_contains(relevant, x) THEN i END), lambda i: i IS NOT NULL)) AS first_hit
       FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN got USING (query_id) LEFT JOIN rel USING (query_id)),
mt AS (SELECT query_id, round_even(len(list_intersect(relevant, retrieved[1:1]))::DOUBLE / n, 3) AS recall_1,
              round_even(len(list_intersect(relevant, retrieved[1:3]))::DOUBLE / n, 3) AS recall_3,
              round_even(len(list_intersect(relevant, retrieved[1:5]))::DOUBLE / n, 3) AS recall_5,
              round_even(len(list_intersect(relevant, retrieved[1:6]))::DOUBLE / n, 3) AS recall_6,
              CASE WHEN n > 0 THEN round_even(coalesce(1::DOUBLE / first_hit, 0), 3) END AS mrr, list_has_any(relevant, retrieved[1:5])::INT::DOUBLE AS hit_rate_5 FROM ev)"""

#: Queries follow from replies alone, so all that may be asked are retrieved first; which are is a matter of counts.
ROUNDS_SQL = HITS.replace(" benchmark", " pq").replace("WITH tok AS", """WITH said AS (SELECT b.item_id AS question_id, b.text AS question, c.turn AS call, coalesce(c.text, '') AS t FROM benchmark b JOIN conversations c ON c.conv_id = b.item_id),
ks AS (SELECT b.item_id AS question_id, b.text AS question, k.k, s.call IS NOT NULL AS there, coalesce(length(s.t) % 5 = 0 OR (length(s.t) % 100) / 100.0 >= 0.8 OR length(s.t) % 7 = 3 OR s.t = '', false) AS enough,
              CASE WHEN s.call IS NULL THEN b.text ELSE left(s.t, 50) END AS ask
       FROM benchmark b CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) k LEFT JOIN said s ON s.question_id = b.item_id AND s.call = k.k),
pq0 AS (SELECT b.item_id AS question_id, 0 AS step, 0 AS place, coalesce(nullif(left(s.t, 60), ''), b.text) AS text FROM benchmark b LEFT JOIN said s ON s.question_id = b.item_id AND s.call = 0
        UNION ALL SELECT question_id, 0, 1, substr(t, 61, 60) FROM said WHERE call = 0 AND length(t) > 60
        UNION ALL SELECT question_id, k, 0, ask FROM ks),
pq AS (SELECT (question_id * 4 + step) * 2 + place AS item_id, * FROM pq0),
tok AS""", 1) + """,
hs AS (SELECT question_id, step, step * 64000000 + place * 1000000 + rank AS seen, chunk_id, score FROM h JOIN pq ON pq.item_id = h.query_id),
fs AS (SELECT question_id, chunk_id, min(step) AS step FROM hs GROUP BY ALL),
ns AS (SELECT question_id, count(*) FILTER (step <= 0) AS n0, count(*) FILTER (step <= 1) AS n1, count(*) FILTER (step <= 2) AS n2, count(*) AS n3 FROM fs GROUP BY question_id),
ev AS (SELECT question_id, bool_or(enough) FILTER (k = 1) AS e1, bool_or(enough) FILTER (k = 2) AS e2, bool_or(enough) FILTER (k = 3) AS e3 FROM ks GROUP BY question_id),
en AS (SELECT *, CASE WHEN e1 THEN 0 WHEN e2 THEN 1 WHEN n2 = n1 AND n1 = n0 OR e3 THEN 2 ELSE 3 END AS last,
              CASE WHEN e1 THEN 1 WHEN e2 OR n2 = n1 AND n1 = n0 THEN 2 ELSE 3 END AS iterations,
              CASE WHEN e1 OR e2 THEN '' WHEN n2 = n1 AND n1 = n0 THEN 'no new chunks; stopping' WHEN e3 THEN '' WHEN n3 = n2 AND n2 = n1 THEN 'no new chunks; stopping' ELSE '' END AS note FROM ns JOIN ev USING (question_id)),
mh AS (SELECT question_id, chunk_id, max(score) AS score, min(seen) AS seen FROM hs JOIN en USING (question_id) WHERE step <= last GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS rank FROM mh),
ch AS (SELECT question_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunks FROM tp WHERE rank <= 6 GROUP BY question_id)
SELECT question_id, iterations::BIGINT AS iterations, (1 + (SELECT sum(CASE WHEN there THEN 1 ELSE 2 END) FROM ks WHERE ks.question_id = en.question_id AND k <= iterations))::BIGINT AS llm_calls,
       [n0, n1, n2, n3][last + 1] AS retrieved_total, note, chunks FROM en LEFT JOIN ch USING (question_id)"""

ANSWERS = """WITH a AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 5 WHEN 0 THEN ' [1][2].' WHEN 1 THEN ' [9].' WHEN 2 THEN '' WHEN 3 THEN ' [3] and [0], [12] ' ELSE ' [１].' END AS answer FROM conversations),
d AS (SELECT *, translate(answer, '０１２３４５６７８９', '0123456789') AS plain FROM a),
c AS (SELECT conv_id, turn, answer, list_sort(list_distinct(list_transform(regexp_extract_all(plain, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT))) AS cited FROM d)"""
INVALID = "list_filter(cited, lambda x: x < 1 OR x > 6)"

CAPTIONS = """WITH blocks AS (SELECT * FROM (VALUES
 ('a.pdf', 1, 0, 1, [10.0, 10.0, 100.0, 80.0], ''), ('a.pdf', 1, 1, 0, [10.0, 85.0, 100.0, 95.0], '图1 光路'),
 ('a.pdf', 1, 2, 0, [10.0, 200.0, 100.0, 210.0], 'Table 2 sizes'), ('a.pdf', 2, 0, 1, [0.0, 50.26, 10.0, 60.0], ''),
 ('a.pdf', 2, 1, 0, [0.0, 45.0, 10.0, 50.26], '公式（3）'), ('a.pdf', 2, 2, 0, [0.0, 60.0, 10.0, 70.0], 'Figure 4 same gap'),
 ('b.pdf', 1, 0, 0, [0.0, 0.0, 1.0, 1.0], 'plain text'), ('b.pdf', 1, 1, 1, [0.0, 5.0, 1.0, 9.0], '')) t(path, page, pos, type, bbox, text)),"""
CAPTIONS_SQL = CAPTIONS + """
m AS (SELECT i.path, i.page, i.pos, i.bbox, c.text, c.pos AS cp, least(abs(c.bbox[2] - i.bbox[4]), abs(i.bbox[2] - c.bbox[4])) AS gap
      FROM blocks i LEFT JOIN blocks c ON c.path = i.path AND c.page = i.page AND c.type = 0
        AND regexp_matches(c.text, '(?i)^\\s*(图|表|公式|式|Fig\\.?|Figure|Table|Equation)') WHERE i.type = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY path, page, pos ORDER BY gap, cp) AS k FROM m)
SELECT path, page, row_number() OVER (PARTITION BY path ORDER BY page, pos)::INT AS index, coalesce(text, '') AS caption,
  CASE WHEN regexp_matches(text, '(?i)^(表|Table)') THEN 'table' WHEN regexp_matches(text, '(?i)^(公式|式|Equation)') THEN 'equation' ELSE 'figure' END AS kind
FROM r WHERE k = 1"""

SQL = {
    "token_count": f"SELECT doc_id, {TOKENS.format('coalesce(text, chr(32))')}::BIGINT AS n_tokens FROM documents",
    "tokenize_terms": f"SELECT doc_id, len({WORDS})::BIGINT AS n_tokens, len(list_distinct({WORDS}))::BIGINT AS n_terms FROM documents",
    "cjk_bigrams": """WITH t AS (SELECT * FROM (VALUES (1, '检索增强生成'), (2, 'CODE V 光学设计 MicroLED 2024'), (3, '检X索'), (4, '！！！'), (5, ''), (6, '光')) t(id, text)),
c AS (SELECT id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]') AS s FROM t)
SELECT id, array_to_string(list_concat(list_concat(w, s), list_transform(range(1, len(s)), lambda i: s[i] || s[i + 1])), '|') AS tokens FROM c""",
    "hard_split_chunks": "SELECT doc_id, unnest(range(0, length(text), 1200)) // 1200 AS pos, md5(substr(text, unnest(range(0, length(text), 1200))::INT + 1, 1200)) AS digest FROM documents WHERE length(text) > 0",
    "recursive_chunks": chunks() + f"\nSELECT chunk_id, doc_id, pos, md5(text) AS digest, {TOKENS.format('text')}::BIGINT AS n_tokens FROM ch",
    "sql_chunks": chunks() + f"\nSELECT doc_id, pos, md5(text) AS digest, {TOKENS.format('text')}::BIGINT AS n_tokens FROM ch",
    "chunk_stats": chunks() + f"\nSELECT source, count(*) AS n_chunks, sum({TOKENS.format('text')})::BIGINT AS n_tokens, max({TOKENS.format('text')})::BIGINT AS largest FROM ch GROUP BY source",
    "bm25_term_stats": f"{STATS} SELECT term, df, round(idf, 4) AS idf FROM idf",
    "index_snapshot": f"{STATS} SELECT 1::BIGINT AS version, (SELECT count(*) FROM tok) AS chunk_count, (SELECT count(*) FROM tok) AS vector_count, (SELECT count(*) FROM (SELECT DISTINCT source FROM tok)) AS source_count, 64::BIGINT AS embed_dim, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM tf) AS n_postings",
    "bm25_search": f"{LEXICAL} SELECT query_id, rank, chunk_id, score FROM b",
    "hashed_embedding": f"{STATS}, hv AS (SELECT chunk_id, {BUCKET} AS bucket, sum(tf)::DOUBLE AS c FROM tf GROUP BY ALL) SELECT chunk_id AS doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)), 6) AS weight FROM hv",
    "vector_search": f"{LEXICAL}, {DENSE} SELECT query_id, rank, chunk_id, score FROM v",
    "label_neighbours": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS y, unnest(range(len(v))) AS i FROM e),
c AS (SELECT label, i, avg(y) AS y FROM x GROUP BY ALL), cn AS (SELECT label, sqrt(sum(y * y)) AS size FROM c GROUP BY label), en AS (SELECT vec_id, sqrt(sum(y * y)) AS size FROM x GROUP BY vec_id),
s AS (SELECT c.label AS query_id, x.vec_id AS chunk_id, round(sum(c.y * x.y) / (any_value(cn.size) * any_value(en.size)), 6) AS score FROM c JOIN x USING (i) JOIN cn ON cn.label = c.label JOIN en ON en.vec_id = x.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank, chunk_id, score FROM s) SELECT query_id::BIGINT AS query_id, rank, chunk_id, score FROM r WHERE rank < 20""",
    "rrf_fusion": f"{FUSED} SELECT query_id, chunk_id, fused_rank, score, vector_score, bm25_score FROM f",
    "candidate_cut": f"{FUSED} SELECT query_id, count(*) AS n, sum(chunk_id)::BIGINT AS ids FROM f WHERE fused_rank < 24 GROUP BY query_id",
    "hybrid_retrieve": f"{HITS} SELECT query_id, rank, chunk_id, source, score, vector_score, bm25_score FROM h",
    "cosine_rerank": f"""{FUSED}, rr AS (SELECT f.query_id, f.chunk_id, vs.score, f.fused_rank FROM f JOIN vs USING (query_id, chunk_id) WHERE fused_rank < 24)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) - 1 AS rank, chunk_id, score FROM rr QUALIFY rank < 6""",
    "multi_query_merge": f"{MERGED} SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, seen) - 1 AS rank, chunk_id, source, score, vector_score FROM mg QUALIFY rank < 6",
    "context_block": f"{HITS} SELECT query_id, md5(string_agg('[' || (rank + 1) || '] (source: ' || source || ')' || chr(10) || CASE WHEN length(text) > 1200 THEN left(text, 1200) || '…' ELSE text END, chr(10) || chr(10) ORDER BY rank)) AS digest FROM h GROUP BY query_id",
    "recall_mrr_hit": f"{JUDGED} SELECT * FROM mt",
    "eval_means": f"{JUDGED} SELECT count(*) AS n, round_even(avg(recall_1), 3) AS recall_1, round_even(avg(recall_3), 3) AS recall_3, round_even(avg(recall_5), 3) AS recall_5, round_even(avg(recall_6), 3) AS recall_6, round_even(avg(mrr), 3) AS mrr, round_even(avg(hit_rate_5), 3) AS hit_rate_5 FROM mt",
    "agent_rounds": ROUNDS_SQL,
    "citation_validate": f"{ANSWERS} SELECT conv_id, turn, array_to_string(cited, ',') AS citations, array_to_string({INVALID}, ',') AS invalid, len({INVALID}) = 0 AS valid, len(cited) > 0 AS has_citation FROM c",
    "citation_abstain": f"{ANSWERS} SELECT conv_id, turn, trim(answer) = '' OR len(cited) = 0 AS abstain FROM c",
    "citation_answer": f"{ANSWERS} SELECT conv_id, turn, CASE WHEN trim(answer) = '' OR len(cited) = 0 THEN '{ABSTAIN}' WHEN len({INVALID}) = 0 THEN answer ELSE rtrim(answer, ' ' || chr(10)) || {_text(WARNING[0])} || array_to_string(list_transform({INVALID}, lambda i: '[' || i || ']'), ', ') || {_text(WARNING[1])} END AS answer FROM c",
    "unsupported_numbers": """WITH p AS (SELECT d.doc_id, d.text AS answer, string_agg(o.text, ' ' ORDER BY o.item_id) AS context FROM documents d CROSS JOIN (SELECT * FROM benchmark) o GROUP BY d.doc_id, d.text),
n AS (SELECT doc_id, context, list_transform(regexp_extract_all(coalesce(answer, ''), '-?\\d+(?:\\.\\d+)?%?'), lambda x: regexp_replace(x, '%$', '')) AS numbers FROM p)
SELECT doc_id, len(numbers)::BIGINT AS n_numbers, array_to_string(list_filter(numbers, lambda x: NOT contains(replace(context, ' ', ''), x) AND NOT contains(context, x)), ',') AS unsupported FROM n""",
    "parse_json_verdict": "SELECT event_id, (props->>'$.k')::DOUBLE AS k, greatest(0::DOUBLE, least(1::DOUBLE, (props->>'$.k')::DOUBLE / 100)) AS confidence FROM events",
    "nearest_caption": CAPTIONS_SQL,
    "source_counter": "SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source",
    "dedup_sources": "SELECT lang, array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ',') AS sources FROM documents GROUP BY lang",
    "clamp_scores": "SELECT event_id, greatest(0::DOUBLE, least(1::DOUBLE, value / 100)) AS score FROM events",
    "sparse_texts": "SELECT source, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 30) AS n_sparse FROM documents GROUP BY source",
    "cache_keys": "SELECT doc_id, substr(sha256('[\"embed\",\"' || doc_id || '\",\"' || coalesce(lang, '') || '\"]'), 1, 40) AS key FROM documents",
}
