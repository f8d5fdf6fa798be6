"""The registered queries in DuckDB's SQL, written apart from their DataFrame forms."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.text import BOILERPLATE
from ..sources import engines as E
from ..sources.tables import ENGINES, LINKS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
LOW = f"lower({TRIM.format('query')})"

TIERS = "CASE " + " ".join(f"WHEN engine IN ({', '.join(map(quoted, names))}) THEN {w}" for w, names in L.ENGINE_WEIGHTS.items()) + " ELSE 1.0 END"
WEIGHT = f"CAST(CAST({TIERS} AS FLOAT) AS DOUBLE)"

RAW = f"""
raw AS (
  SELECT page_id, url, engine, ('0x' || substr(md5(engine || '|' || url), 1, 8))::BIGINT % {LINKS} + 1 AS rank_position
  FROM pages CROSS JOIN (SELECT unnest({listed(list(ENGINES))}) AS engine)
)"""

NORM = rf"""
norm AS (
  SELECT page_id, url, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
         || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS norm_url,
         host || regexp_replace(lower(CASE WHEN path = '' THEN '/' ELSE path END), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS dedup_key,
         host, path
  FROM (
    SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host,
           regexp_extract(url, '^[A-Za-z]+://[^/?#:]+:([0-9]*)', 1) AS port, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path,
           list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({listed(L.TRACKING)}, lower(string_split(p, '=')[1]))),
                          lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS kept
    FROM pages
  )
)"""

HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
QUERIES = "q AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user')"
WORDS = rf"len(list_filter(regexp_split_to_array({LOW}, '[\s\p{{Z}}]+'), lambda w: w <> ''))"
INTENT = f"""CASE WHEN {WORDS} <= 3 AND ({' OR '.join(f"(contains({LOW}, {quoted(s)}) AND (contains({LOW}, 'login') OR contains({LOW}, 'website') OR {LOW} = {quoted(s)}))" for s in L.NAVIGATION_SITES)}) THEN 'navigational'
  WHEN {has(LOW, L.COMPARISON)} OR (contains({LOW}, ' or ') AND {has(LOW, ['which', 'better'])}) THEN 'comparison'
  WHEN {has(LOW, L.PERSON)} THEN 'person' WHEN {has(LOW, L.HOWTO)} THEN 'howto' WHEN {has(LOW, L.TEMPORAL)} OR {has(LOW, L.ROLES)} THEN 'temporal'
  WHEN {WORDS} >= 8 OR {has(LOW, L.RESEARCH)} THEN 'research' ELSE 'factual' END"""
HINT = (
    "CASE "
    + " ".join(f"WHEN contains({LOW}, {quoted(w)}) THEN {quoted(w)}" for w in [*L.RECENCY, *L.RELATIVE])
    + f" WHEN {has(LOW, L.IMPLICIT)} OR {INTENT} = 'temporal' THEN 'current' "
    + " ".join(f"WHEN contains({LOW}, {quoted(w)}) THEN {quoted(w)}" for w in L.YEARS)
    + " END"
)

TOKENS = rf"list_filter(regexp_split_to_array(lower({{0}}), '[^\p{{{{L}}}}\p{{{{M}}}}\p{{{{N}}}}]+'), lambda t: strlen(t) >= 2 AND NOT list_contains({listed(L.STOPWORDS)}, t))"


def tokens(text: str) -> str:
    return TOKENS.format(text)


FIRST_SIX = r"array_to_string(regexp_split_to_array(text, '\s+')[1:6], ' ')"
BM25 = f"""
terms AS (SELECT item_id AS query_id, lower({FIRST_SIX}) AS phrase, unnest(list_distinct({tokens(FIRST_SIX)})) AS term FROM benchmark),
docs AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
sizes AS (SELECT count(*) AS n, greatest(sum(len(t)), 1) / greatest(count(*), 1) AS avgdl FROM docs),
split AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs),
counted AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM split WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term),
freq AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
parts AS (
  SELECT query_id, phrase, doc_id, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, tf, dl, avgdl
  FROM terms JOIN counted USING (term) JOIN freq USING (term) CROSS JOIN sizes
),
bm AS (
  SELECT query_id, phrase, doc_id, sum(idf * tf * {L.BM25_K1 + 1} / (tf + {L.BM25_K1} * ({1 - L.BM25_B} + {L.BM25_B} * greatest(dl, 1) / avgdl)) + {L.BM25_DELTA} * idf) AS bm25
  FROM parts GROUP BY query_id, phrase, doc_id
), filled AS (
  SELECT query_id, phrase, doc_id, coalesce(bm25, 0) AS bm25 FROM (SELECT DISTINCT query_id, phrase FROM terms) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN bm USING (query_id, phrase, doc_id)
)"""

PIECES = r"string_split(regexp_replace({0}, '([.!?]) (\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1))"
CHUNKS = f"""
trimmed AS (SELECT doc_id, {TRIM.format("replace(text, chr(13), '')")} AS body FROM documents),
pieces AS (SELECT doc_id, body, {PIECES.format('body')} AS p FROM trimmed),
folded AS (
  SELECT doc_id, body, p,
    list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform(p[1:len(p) - 1], lambda x: {{'done': []::VARCHAR[], 'open': x}})),
      lambda s, x: CASE WHEN length(CASE WHEN s.open = '' THEN x.open ELSE s.open || ' ' || x.open END) >= {L.CHUNK_LEAST}
        THEN {{'done': list_append(s.done, CASE WHEN s.open = '' THEN x.open ELSE s.open || ' ' || x.open END), 'open': ''}}
        ELSE {{'done': s.done, 'open': CASE WHEN s.open = '' THEN x.open ELSE s.open || ' ' || x.open END}} END) AS f
  FROM pieces
),
rested AS (SELECT doc_id, body, f, {TRIM.format("CASE WHEN f.open = '' THEN p[-1] ELSE f.open || ' ' || p[-1] END")} AS rest FROM folded),
chunked AS (
  SELECT doc_id, CASE WHEN body = '' THEN []::VARCHAR[] WHEN length(body) <= {L.CHUNK_MOST} THEN [body] WHEN rest = '' THEN f.done
    WHEN length(rest) < {L.CHUNK_LEAST} AND len(f.done) > 0 THEN list_append(f.done[1:len(f.done) - 1], f.done[-1] || ' ' || rest) ELSE list_append(f.done, rest) END AS c
  FROM rested
)"""

RANKED = f"""
trimmed AS (SELECT source || '/' || CAST(floor(doc_id / 1000) AS BIGINT) AS part, doc_id, {TRIM.format('text')} AS text FROM documents),
ranked AS (SELECT part, doc_id, text, row_number() OVER (PARTITION BY part ORDER BY strlen(text) DESC, doc_id) AS place FROM trimmed)"""

JUDGED = """
run AS (SELECT source AS query_id, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)) DESC, doc_id) AS rank FROM documents),
qrels AS (SELECT source AS query_id, doc_id AS item, quality * (2 - toxic) + quality AS grade FROM documents JOIN labels USING (doc_id)),
judged AS (SELECT run.query_id, run.item, rank, coalesce(grade, 0) AS grade FROM run LEFT JOIN qrels USING (query_id, item)),
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS r FROM qrels) WHERE r <= 10 GROUP BY query_id),
gains AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg, coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0) AS rr,
                 count(*) FILTER (rank <= 10 AND grade > 0) AS h10, count(*) FILTER (rank <= 20 AND grade > 0) AS h20 FROM judged GROUP BY query_id),
total AS (SELECT query_id, count(*) FILTER (grade > 0) AS total FROM qrels GROUP BY query_id),
means AS (
  SELECT query_id, coalesce(dcg, 0) AS dcg, coalesce(idcg, 0) AS idcg, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg, rr,
         CASE WHEN total > 0 THEN h10 / total ELSE 0 END AS r10, CASE WHEN total > 0 THEN h20 / total ELSE 0 END AS r20
  FROM gains LEFT JOIN ideal USING (query_id) LEFT JOIN total USING (query_id)
)"""

SAID = r"CASE WHEN (conv_id * 7 + turn) % 3 = 0 THEN '<think>let me see' || chr(10) || 'well</think>' ELSE '' END || CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN 'Here is a summary' || chr(10) ELSE '' END || CASE WHEN (conv_id * 7 + turn) % 2 = 0 THEN regexp_replace(text, '\.$', '') || ' [1].' ELSE text END"
PLAIN = r"regexp_replace({0}, '(?is)<think>.*?(</think>|$)', '', 'g')"
AT = "epoch_us(ts) / 1000000.0"
SCORED = f"""
per AS (SELECT query_id, list(term) AS ts FROM terms GROUP BY query_id),
scored AS (
  SELECT query_id, doc_id, strlen(text) AS size, length(text) AS chars,
    (bm25 + CASE WHEN phrase <> '' AND contains(lower(text), phrase) THEN {L.PHRASE_BONUS} ELSE 0 END
      + {L.TITLE_BONUS} * len(list_filter(ts, lambda t: contains(lower(array_to_string(regexp_split_to_array(text, '\\s+')[1:4], ' ')), t))))
    * (1 + {L.CONSENSUS} * ((doc_id % 7 + 1) / ({L.RRF_K} + doc_id % 40 + 1)) / (SELECT max((doc_id % 7 + 1) / ({L.RRF_K} + doc_id % 40 + 1)) FROM documents)) + {L.CONFIDENCE_WEIGHT} * ({L.CONFIDENCE} - 0.5) AS score
  FROM filled bm JOIN documents USING (doc_id) JOIN per USING (query_id)
)"""

# judged lists of addresses: those of the last entry of a query count, under the normalised address if it is judged, else under the plain one
GOLDEN = f"""{NORM},
met AS (SELECT page_id, url, norm_url, page_id % (SELECT count(*) FROM benchmark) AS query_id FROM norm),
said AS (SELECT item_id AS query_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:6], ' ') || ' ' || item_id AS query FROM benchmark),
lists AS (SELECT query_id, lower(query) AS key, CASE WHEN query_id % 2 = 0 THEN lower(query) ELSE query END AS said, url, norm_url, row_number() OVER (PARTITION BY query_id ORDER BY md5(url), page_id) AS rank FROM met JOIN said USING (query_id)),
qrels AS (SELECT query_id, CASE WHEN page_id % 2 = 0 THEN norm_url ELSE url END AS item, max(page_id % 4) AS grade FROM met WHERE query_id % 5 <> 4 GROUP BY 1, 2),
graded AS (SELECT l.query_id, key, rank, coalesce(a.grade, b.grade, 0) AS grade FROM lists l LEFT JOIN qrels a ON a.query_id = l.query_id AND a.item = l.norm_url LEFT JOIN qrels b ON b.query_id = l.query_id AND b.item = l.url WHERE l.query_id IN (SELECT query_id FROM qrels)),
perfect AS (SELECT query_id, sum(CASE WHEN k <= 10 THEN (pow(2, grade) - 1) / log2(k + 1) ELSE 0 END) AS idcg, count(*) FILTER (grade > 0) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS k FROM qrels) GROUP BY query_id),
scores AS (SELECT query_id, any_value(key) AS key, coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, any_value(idcg) AS idcg, any_value(total) AS total, coalesce(1.0 / min(rank) FILTER (grade > 0), 0) AS rr,
                  count(*) FILTER (rank <= 10 AND grade > 0) AS h10, count(*) FILTER (rank <= 20 AND grade > 0) AS h20 FROM graded JOIN perfect USING (query_id) GROUP BY query_id)"""

SOURCES = f"""
src AS (SELECT item_id AS query_id, array_to_string(regexp_split_to_array(b.text, '\\s+')[1:6], ' ') AS query, d.doc_id AS source_id, 'https://' || d.source || '.example.org/' || d.doc_id AS url,
               array_to_string(regexp_split_to_array(d.text, '\\s+')[1:4], ' ') AS title, d.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""

HITS = f"""{RAW}, {NORM},
changed AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.reddit.com/x.com/' || page_id WHEN 1 THEN regexp_replace(url, '^https?:', 'HTTP:') ELSE url END AS url, CASE page_id % 5 WHEN 0 THEN 'https://www.reddit.com/x.com/' || page_id WHEN 1 THEN regexp_replace(norm_url, '^https?:', 'http:') ELSE norm_url END AS norm_url,
                   CASE page_id % 5 WHEN 0 THEN 'www.reddit.com/x.com/' || page_id ELSE dedup_key END AS dedup_key, path FROM norm),
hits AS (SELECT page_id % (SELECT count(*) FROM benchmark) AS query_id, page_id, c.url, norm_url, dedup_key, path, engine, rank_position FROM raw JOIN changed c USING (page_id) WHERE engine IN ('google', 'bing', 'wiby') AND page_id % (SELECT count(*) FROM benchmark) % 7 <> 6),
passed AS (SELECT *, page_id % 5 = 0 OR {has('lower(url)', L.SKIP_DOMAINS)} OR {' OR '.join(f"suffix(lower(path), {quoted(e)})" for e in L.SKIP_EXTENSIONS)} AS passed FROM hits),
kept AS (SELECT * FROM passed WHERE NOT passed),
focused AS (SELECT * FROM passed WHERE NOT passed OR (query_id % 4 = 0 AND contains(norm_url, '//www.reddit.com')))"""

SQL = {
    "rrf_scores": f"WITH {RAW}, {NORM} SELECT norm_url, round(sum({WEIGHT} / ({L.RRF_K} + greatest(rank_position, 1))), 9) AS rrf, count(*) AS hits FROM raw JOIN norm USING (page_id) GROUP BY norm_url",
    "rrf_topk": f"WITH {RAW}, {NORM} SELECT norm_url, round(sum({WEIGHT} / ({L.RRF_K} + greatest(rank_position, 1))), 9) AS rrf FROM raw JOIN norm USING (page_id) GROUP BY norm_url ORDER BY rrf DESC, norm_url LIMIT 50",
    "url_normalize": f"WITH {NORM} SELECT page_id, norm_url, dedup_key FROM norm",
    "url_skip_filter": f"SELECT page_id, {has('lower(url)', L.SKIP_DOMAINS)} OR " + " OR ".join(f"suffix(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)), {quoted(e)})" for e in L.SKIP_EXTENSIONS) + " AS skipped FROM pages",
    "url_dedup": f"""WITH {RAW}, {NORM} SELECT dedup_key, norm_url, engine, rank_position FROM (
        SELECT dedup_key, norm_url, engine, rank_position, row_number() OVER (PARTITION BY dedup_key ORDER BY rank_position, engine, raw.url) AS k FROM raw JOIN norm USING (page_id)
        WHERE NOT {has('lower(raw.url)', L.SKIP_DOMAINS)} AND NOT ({' OR '.join(f"suffix(lower(path), {quoted(e)})" for e in L.SKIP_EXTENSIONS)})) WHERE k = 1""",
    "engine_by_url": f"WITH {RAW}, {NORM}, j AS (SELECT *, first_value(engine) OVER (PARTITION BY norm_url ORDER BY rank_position, engine, raw.url) AS first_engine FROM raw JOIN norm USING (page_id)) SELECT first_engine, count(*) AS n, sum(rank_position)::BIGINT AS ranks FROM j GROUP BY first_engine",
    "engine_sets": "SELECT mode, ord::INT AS ord, engine, " + WEIGHT + " AS weight FROM (VALUES " + ", ".join(f"({quoted(m)}, {i}, {quoted(e)})" for m, es in L.ENGINE_SETS.items() for i, e in enumerate(es)) + ") t(mode, ord, engine)",
    "credibility_tag": "SELECT page_id, CASE WHEN suffix(h, '.gov') OR suffix(h, '.edu') THEN " + quoted(L.INSTITUTIONAL) + " " + " ".join(f"WHEN contains(h, {quoted(n)}) THEN {quoted(t)}" for n, t in L.CREDIBILITY)
    + r" ELSE '[General Web - ' || regexp_replace(h, '^(www\.)+', '') || ']' END AS tag, CAST(CAST(CASE WHEN suffix(h, '.gov') OR suffix(h, '.edu') THEN 1.5 " + " ".join(f"WHEN {has('h', ns)} THEN {t}" for t, ns in L.TRUST)
    + f" ELSE 1.0 END AS FLOAT) AS DOUBLE) AS trust FROM (SELECT page_id, {HOST} AS h FROM pages)",
    "redirect_resolve": "SELECT page_id, CASE WHEN page_id % 7 = 6 THEN NULL WHEN page_id % 7 = 4 THEN 'https://p.example/?uddg=' || replace(url_encode(url), '%20', '+') WHEN page_id % 7 = 2 THEN regexp_replace(url, '^https?:', 'https:') ELSE url END AS target FROM pages",
    "query_analysis": f"""WITH {QUERIES}, a AS (SELECT query_id, {INTENT} AS intent, {HINT} AS temporal_hint, CASE WHEN {WORDS} <= 3 THEN 'simple' WHEN {WORDS} <= 8 THEN 'medium' ELSE 'complex' END AS complexity, {has(LOW, L.NEWS)} AS news FROM q),
        b AS (SELECT *, CASE WHEN intent = 'factual' THEN CASE WHEN complexity = 'simple' THEN 15 ELSE 20 END WHEN intent = 'comparison' THEN 30 WHEN intent = 'navigational' THEN 10 WHEN intent = 'research' THEN 40 ELSE 25 END AS optimal_sources FROM a)
        SELECT query_id, intent, temporal_hint, complexity, temporal_hint IS NOT NULL OR news AS boost_news, temporal_hint IS NOT NULL AS is_time_sensitive, optimal_sources,
               CASE WHEN intent = 'navigational' THEN 30 WHEN complexity = 'simple' THEN 50 ELSE 100 END AS url_cap, greatest(optimal_sources, 25) AS chunk_count FROM b""",
    "query_entities": rf"""WITH {QUERIES}, w AS (SELECT query_id, unnest(list_filter(list_transform(regexp_split_to_array(query, '[\s\p{{Z}}]+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+$', '', 'g')), lambda x: x <> '')) AS word, generate_subscripts(list_filter(list_transform(regexp_split_to_array(query, '[\s\p{{Z}}]+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+$', '', 'g')), lambda x: x <> ''), 1) AS i FROM q),
        n AS (SELECT *, regexp_matches(word, '^\p{{Lu}}') AND NOT list_contains({listed(L.ENTITY_STOPWORDS)}, lower(word)) AND strlen(word) > 1 AS named FROM w),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY query_id, named ORDER BY i) AS run FROM n),
        e AS (SELECT query_id, string_agg(word, ' ' ORDER BY i) AS entity, min(i) AS i FROM g WHERE named GROUP BY query_id, run),
        f AS (SELECT query_id, entity, min(i) AS i FROM e GROUP BY query_id, entity)
        SELECT query_id, coalesce(string_agg(entity, '|' ORDER BY i), '') AS entities FROM q LEFT JOIN f USING (query_id) GROUP BY query_id""",
    "query_rewrite": f"""WITH {QUERIES} SELECT query_id, md5({TRIM.format('query')} || CASE query_id % 4 WHEN 0 THEN ' site:reddit.com' WHEN 1 THEN ' site:youtube.com' WHEN 2 THEN ' site:edu OR site:gov OR site:nature.com' ELSE '' END) AS focused,
        md5({TRIM.format('query')} || CASE WHEN {HINT} IS NOT NULL AND NOT {has(LOW, L.YEARS)} THEN ' 2026' ELSE '' END) AS dated, CASE WHEN {LOW} = '' THEN 0 ELSE 3 END AS n_variations FROM q""",
    "tokenize_counts": rf"SELECT doc_id, len({tokens('text')}) AS n_tokens, len(list_distinct({tokens('text')})) AS n_distinct, len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: strlen(t) >= 2)) AS n_raw FROM documents",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tokens('text')})) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n_chunks, sum(n)::BIGINT AS total_tokens, round(greatest(sum(n), 1) / greatest(count(*), 1), 6) AS avgdl FROM (SELECT len({tokens('text')}) AS n FROM documents)",
    "bm25_plus_topk": f"WITH {BM25} SELECT query_id, doc_id, bm25, rank FROM (SELECT query_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM filled) WHERE rank <= 10",
    "hybrid_scores": f"WITH {BM25}, {SCORED} SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
    "mmr_topk": f"""WITH RECURSIVE {BM25}, {SCORED}, s AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chars DESC, doc_id) AS seq, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9) AS rel FROM (SELECT query_id, doc_id, chars, round(score, 9) AS score FROM scored)),
        t AS (SELECT doc_id, list_distinct(t) AS ts FROM docs),
        p AS (SELECT query_id, doc_id, seq, score, rel, 0.0::DOUBLE AS sim, 0 AS step, false AS chosen FROM s
              UNION ALL
              SELECT w.query_id, w.doc_id, w.seq, w.score, w.rel, greatest(w.sim, CASE WHEN len(a.ts) + len(c.ts) = 0 THEN 1.0 ELSE len(list_intersect(a.ts, c.ts)) / (len(a.ts) + len(c.ts) - len(list_intersect(a.ts, c.ts))) END), w.step + 1, w.doc_id = w.best
              FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY query_id ORDER BY 0.7 * rel - (1 - 0.7) * sim DESC, seq) AS best FROM p WHERE NOT chosen AND step < 10) w JOIN t a ON a.doc_id = w.doc_id JOIN t c ON c.doc_id = w.best)
        SELECT query_id, doc_id, round(score, 6) AS score, seq, step AS mmr_rank FROM p WHERE chosen""",
    "count_or_timeout_batches": f"""WITH RECURSIVE e AS (SELECT user_id, {AT} AS sec, row_number() OVER (PARTITION BY user_id ORDER BY {AT}, event_id) AS rn FROM events),
        b AS (SELECT user_id, 0 AS batch, rn AS first, sec AS start FROM e WHERE rn = 1
              UNION ALL SELECT b.user_id, b.batch + 1, min(x.rn), arg_min(x.sec, x.rn) FROM b JOIN e x ON x.user_id = b.user_id AND x.rn > b.first AND (x.rn >= b.first + 30 OR x.sec - b.start > 3600) GROUP BY b.user_id, b.batch),
        n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)
        SELECT user_id, batch, coalesce(lead(first) OVER (PARTITION BY user_id ORDER BY batch), n + 1) - first AS n, start FROM b JOIN n USING (user_id)""",
    "sentence_chunks": f"WITH {CHUNKS} SELECT doc_id, i - 1 AS chunk_idx, length(c[i]) AS n_chars, md5(c[i]) AS md5 FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM chunked)",
    "chunk_overlap": f"""WITH {CHUNKS}, e AS (SELECT doc_id, c, i, CAST(floor(length(c[i - 1]) * {L.OVERLAP}) AS INT) AS n FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM chunked)),
        w AS (SELECT *, {TRIM.format("CASE WHEN contains(right(c[i - 1], n), ' ') THEN substr(right(c[i - 1], n), strpos(right(c[i - 1], n), ' ')) ELSE right(c[i - 1], n) END")} AS lead FROM e),
        o AS (SELECT doc_id, i - 1 AS chunk_idx, CASE WHEN i = 1 OR n <= 10 OR lead = '' THEN c[i] ELSE lead || '… ' || c[i] END AS chunk FROM w)
        SELECT doc_id, chunk_idx, length(chunk) AS n_chars, md5(chunk) AS md5 FROM o""",
    "text_quality": f"""WITH l AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: {TRIM.format('x')}) AS own FROM documents),
        s AS (SELECT doc_id, text, strlen(text) // 10 + 5 * len(list_filter(own, lambda x: strlen(x) >= 30 AND regexp_matches(x, '[A-Z].*[.!?]$'))) AS score, len(list_filter(own, lambda x: strlen(x) < 15)) / len(own) AS short FROM l)
        SELECT doc_id, CASE WHEN text <> '' AND short > 0.6 THEN score - score // 3 ELSE score END AS quality FROM s""",
    "clean_dedupe": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}\\x{{00AD}}\\x{{2028}}\\x{{2029}}]', '', 'g'), chr(13), chr(10)), chr(10) || chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS parts FROM documents),
        k AS (SELECT doc_id, parts, list_transform(parts, lambda x: left({TRIM.format("regexp_replace(lower(x), '[\\s\\p{Z}]+', ' ', 'g')")}, 80)) AS keys FROM p),
        f AS (SELECT doc_id, list_filter(parts, lambda x, i: list_position(keys, keys[i]) = i) AS first FROM k),
        c AS (SELECT doc_id, list_filter(list_transform(first, lambda x: array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: {TRIM.format('y')}), lambda y: strlen(y) >= 3 AND NOT regexp_matches(y, {quoted(BOILERPLATE)})), ' ')), lambda x: strlen(x) >= 10) AS kept FROM f),
        j AS (SELECT doc_id, {TRIM.format("regexp_replace(array_to_string(kept, chr(10) || chr(10)), '[\\s\\p{Z}]{3,}', ' ', 'g')")} AS done FROM c)
        SELECT doc_id, md5(done) AS md5, length(done) AS n_chars FROM j""",
    "jaccard_pairs": f"WITH d AS (SELECT doc_id, list_distinct({tokens('text')}) AS t FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END, 9) AS jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1",
    "title_extract": r"""WITH p AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS html FROM pages),
        t AS (SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS own, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS head FROM p),
        n AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'Shown ' || page_id WHEN 2 THEN head WHEN 3 THEN own || ' - Site | More' ELSE own END AS title,
              CASE page_id % 4 WHEN 1 THEN 'Shown ' || page_id WHEN 2 THEN head ELSE trim(split_part(split_part(own, ' - ', 1), ' | ', 1)) END AS live FROM t)
        SELECT page_id, md5(title) AS title_md5, md5(live) AS live_title_md5, length(title) AS n_chars FROM n""",
    "video_pages": r"""WITH v AS (SELECT page_id, unnest([false, true]) AS live, page_id % 2 = 0 AS js, page_id % 3 <> 0 AS long FROM pages),
        w AS (SELECT *, CASE WHEN live THEN CASE WHEN long THEN 'meta' WHEN js THEN 'json' ELSE 'article' END ELSE CASE WHEN js THEN 'json' WHEN long THEN 'meta' ELSE 'article' END END AS way FROM v)
        SELECT page_id, live, CASE WHEN live OR way = 'json' THEN 'Video ' || page_id ELSE 'Video ' || page_id || ' - Site' END AS title,
               CASE way WHEN 'json' THEN 'About video ' || page_id || ', "well" & good second' WHEN 'meta' THEN 'A description that is long enough, of video ' || page_id ELSE 'An article beside the video, with words that nobody reads but that are long enough for one.' END AS text,
               CASE way WHEN 'json' THEN 'video_json' WHEN 'meta' THEN 'video_meta' ELSE 'semantic' END AS strategy FROM w""",
    "serp_parse": r"""SELECT page_id, unnest([1, 2, 3]) AS rank, unnest([url, 'https://two.example/?n=' || page_id, 'https://three.example/' || page_id]) AS url,
        unnest(['Page ' || page_id, 'Second hit', 'Third hit']) AS title, unnest(['Spoken', '', '']) AS snippet FROM pages""",
    "engine_serps": r"""WITH e AS (SELECT page_id, regexp_replace(url, '^https?:', 'https:') AS u, unnest(['brave', 'yahoo', 'mojeek', 'qwant', 'startpage', 'duckduckgo', 'bing']) AS engine FROM pages),
        h AS (SELECT page_id, engine, 1 AS page, 1 AS rank, u AS url, 'one ' AS w FROM e UNION ALL SELECT page_id, engine, 1, 2, 'https://two.example/' || page_id, 'two ' FROM e
              UNION ALL SELECT page_id, engine, 2, 2, 'https://three.example/' || page_id, 'three ' FROM e UNION ALL SELECT page_id, engine, 4, 1, 'https://four.example/' || page_id, 'four ' FROM e WHERE engine = 'bing')
        SELECT page_id, engine, page, rank, url, 'Title ' || w || page_id AS title, CASE WHEN engine IN ('qwant', 'startpage') THEN '' ELSE 'Said of ' || w || page_id END AS snippet FROM h""",
    "context_relevance": rf"""WITH w AS (SELECT doc_id, text, lower(array_to_string(regexp_split_to_array(text, '\s+')[1:4], ' ')) AS title, list_filter(regexp_split_to_array(lower(array_to_string(regexp_split_to_array(text, '\s+')[3:7], ' ')), '[\s\p{{Z}}]+'), lambda x: strlen(x) > 2 AND NOT list_contains({listed(L.CONTEXT_STOPWORDS)}, x)) AS kw FROM documents)
        SELECT doc_id, round(CAST(CASE WHEN len(kw) = 0 THEN 1.0::FLOAT ELSE CAST(3 * len(list_filter(kw, lambda x: contains(title, x))) + len(list_filter(kw, lambda x: contains(title || ' ' || lower(text), x))) AS FLOAT) / CAST(len(kw) * 4 AS FLOAT) END AS DOUBLE), 6) AS relevance FROM w""",
    "research_batches": f"WITH {RANKED} SELECT part, doc_id, place, CAST(floor((place - 1) / {L.BATCH}) AS INT) AS batch FROM ranked",
    "lost_in_middle": f"WITH {RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM ranked) SELECT part, doc_id, CAST(CASE WHEN n <= 2 THEN place WHEN place % 2 = 1 THEN (place + 1) // 2 ELSE n + 1 - place // 2 END AS INT) AS place FROM n",
    "context_budget": f"""WITH {RANKED}, s AS (SELECT *, 10 + strlen(part) + strlen(text) AS est FROM ranked),
        b AS (SELECT *, coalesce(sum(est + length(CAST(place AS VARCHAR))) OVER (PARTITION BY part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + est > {4 * L.CONTEXT_BYTES_LITE} AS over_it FROM s),
        m AS (SELECT *, bool_or(over_it) OVER (PARTITION BY part ORDER BY place) AS stopped FROM b) SELECT part, doc_id, place FROM m WHERE NOT stopped""",
    "answer_post_process": f"""WITH a AS (SELECT conv_id, turn, {PLAIN.format(TRIM.format(f'({SAID})'))} AS t FROM conversations WHERE role = 'assistant'),
        b AS (SELECT *, lower(regexp_extract(t, '^([^\\n]*)', 1)) AS line, {TRIM.format("regexp_replace(t, '^[^\\n]*', '')")} AS rest FROM a),
        c AS (SELECT conv_id, turn, {TRIM.format(f"CASE WHEN {has('line', L.PREAMBLES)} AND rest <> '' THEN rest ELSE t END")} AS done FROM b)
        SELECT conv_id, turn, md5(done) AS md5, length(done) AS n_chars, strlen(done) < 80 OR (strlen(done) > 200 AND NOT regexp_matches(done, '\\[[123]\\]')) AS insufficient FROM c""",
    "citation_overlap": rf"""WITH a AS (SELECT conv_id || '/' || turn AS key, {SAID} AS raw, conv_id FROM conversations WHERE role = 'assistant' AND (conv_id * 7 + turn) % 2 = 0),
        c AS (SELECT key, d.text, regexp_extract(left(raw, length(raw) - 4), '(?s)^(?:.*\. )?(.*)$', 1) || '[1]' AS claim FROM a JOIN documents d ON d.doc_id = a.conv_id),
        w AS (SELECT key, lower(' ' || text) AS source, list_distinct(list_filter(regexp_split_to_array(lower(claim), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: strlen(x) > 3)) AS words FROM c),
        o AS (SELECT key, len(list_filter(words, lambda x: contains(source, x))) / len(words) AS overlap FROM w WHERE len(words) > 0)
        SELECT key, 1 AS n, round(overlap, 6) AS overlap, overlap < 0.25 AS flagged FROM o""",
    "ndcg": f"WITH {JUDGED} SELECT query_id, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(ndcg, 6) AS ndcg FROM means",
    "mrr": f"WITH {JUDGED} SELECT query_id, round(rr, 6) AS rr FROM means",
    "recall_at_k": f"WITH {JUDGED} SELECT query_id, round(r20, 6) AS recall FROM means",
    "eval_report": f"""WITH {JUDGED}, v AS (SELECT list_sort(list(value)) AS v FROM events), h AS (SELECT user_id, count(*) FILTER (event_type <> 'error') / count(*) AS rate FROM events GROUP BY user_id),
        c AS (SELECT count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p FROM events)
        SELECT count(*) AS queries_evaluated, round(avg(ndcg), 6) AS mean_ndcg, round(avg(rr), 6) AS mrr, round(avg(r10), 6) AS mean_recall_10, round(avg(r20), 6) AS mean_recall_20,
          {', '.join(f"(SELECT v[CAST(floor({p / 100} * (len(v) - 1) + 0.5) AS BIGINT) + 1] FROM v) AS latency_p{p}" for p in (50, 95, 99))},
          (SELECT count(*) FROM h) AS engines, (SELECT round(avg(rate), 6) FROM h) AS success_rate, (SELECT round(v / (v + c), 6) FROM c) AS engine_hit_ratio, (SELECT round(s / (s + p), 6) FROM c) AS scrape_hit_ratio,
          (SELECT round(c / (c + s), 6) FROM c) AS answer_hit_ratio, 0.7::DOUBLE AS avg_extraction_confidence FROM means""",
    "golden_eval": f"WITH {GOLDEN} SELECT md5(key) AS query_md5, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM scores",
    "golden_report": f"""WITH {GOLDEN} SELECT (SELECT count(DISTINCT said) FROM lists) AS queries_evaluated, count(*) AS judged, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS mean_ndcg, round(avg(rr), 6) AS mrr,
        round(avg(CASE WHEN total > 0 THEN h10 / total ELSE 0 END), 6) AS mean_recall_10, round(avg(CASE WHEN total > 0 THEN h20 / total ELSE 0 END), 6) AS mean_recall_20 FROM scores""",
    "engine_contribution": f"""WITH {RAW}, {NORM}, f AS (SELECT norm_url FROM (SELECT norm_url, round(sum({WEIGHT} / (60.0 + greatest(rank_position, 1))), 9) AS rrf FROM raw JOIN norm USING (page_id) GROUP BY norm_url) ORDER BY rrf DESC, norm_url LIMIT 10)
        SELECT engine, count(*) AS returned, count(*) FILTER (norm_url IN (SELECT norm_url FROM f)) AS in_final, round(count(*) FILTER (norm_url IN (SELECT norm_url FROM f)) / count(*), 6) AS contribution_rate FROM raw JOIN norm USING (page_id) GROUP BY engine""",
    "latency_percentiles": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean FROM events GROUP BY event_type) SELECT event_type, len(v) AS n, "
    + ", ".join(f"v[CAST(floor({p / 100} * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p{p}" for p in (50, 95, 99))
    + ", round(mean, 6) AS mean FROM s",
    "engine_health": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events GROUP BY user_id",
    "cache_hit_ratio": "WITH c AS (SELECT count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p FROM events) SELECT "
    + ", ".join(f"round(CASE WHEN {a} + {b} > 0 THEN {a} / ({a} + {b}) ELSE 0 END, 6) AS {n}_hit_ratio" for a, b, n in (("v", "c", "engine"), ("s", "p", "scrape"), ("c", "s", "answer")))
    + " FROM c",
    "session_ttl": f"""WITH e AS (SELECT *, {AT} AS sec FROM events), g AS (SELECT *, CASE WHEN coalesce(sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id), 600) >= 600 THEN 1 ELSE 0 END AS fresh FROM e),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS session FROM g),
        s AS (SELECT user_id, session, count(*) AS n FROM n GROUP BY user_id, session),
        l AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'scraping_done' WHEN 'click' THEN 'llm_batch' WHEN 'purchase' THEN 'wiped' ELSE 'searching' END AS last_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS k FROM e) WHERE k = 1)
        SELECT user_id, count(*) AS sessions, max(n) AS longest, any_value(last_status) AS last_status FROM s JOIN l USING (user_id) GROUP BY user_id""",
    "cooldown_state": f"WITH e AS (SELECT *, {AT} AS sec FROM events), p AS (SELECT *, lag(event_type) OVER w AS kind, lag(sec) OVER w AS since FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT event_id, user_id, coalesce(kind = 'error' AND sec - since < 120, false) AS cooling FROM p",
    "deadline_filter": f"WITH e AS (SELECT {AT} AS sec, CAST(floor({AT} / 60) AS BIGINT) AS minute FROM events), f AS (SELECT *, min(sec) OVER (PARTITION BY minute) AS first FROM e) SELECT minute, count(*) FILTER (sec - first <= 6) AS kept, count(*) FILTER (sec - first > 6) AS dropped FROM f GROUP BY minute",
    "event_windows": f"SELECT CAST(floor({AT} / 3600) * 3600 AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "engine_requests": f"""WITH e AS (SELECT unnest({listed([n.strip() for n in E.DEFAULT.split(',') if n.strip()])}) AS name),
        i AS (SELECT name, CASE WHEN name IN ('brave', 'brave_news') THEN 'brave' WHEN name IN ('yahoo', 'yahoo_news') THEN 'yahoo' WHEN name IN ('duckduckgo', 'duckduckgo_html', 'duckduckgo_news', 'duckduckgo_images', 'duckduckgo_videos') THEN 'duckduckgo' ELSE name END AS engine FROM e),
        own(engine, tmpl, form, pages, first, step) AS (VALUES
          ('wikipedia', 'https://en.wikipedia.org/w/api.php?action=opensearch&search={{query}}&limit=20&namespace=0&format=json', '', 1, 0, 0), ('wiby', 'https://wiby.me/json/?q={{query}}', '', 1, 0, 0),
          ('duckduckgo', 'https://lite.duckduckgo.com/lite/', 'q={{query}}&s={{offset}}&dc={{next}}', 2, 0, 20), ('brave', 'https://search.brave.com/search?q={{query}}&source=web&offset={{offset}}', '', 3, 0, 10),
          ('yahoo', 'https://search.yahoo.com/search?p={{query}}&n=20&b={{offset}}', '', 5, 1, 10), ('qwant', 'https://www.qwant.com/?q={{query}}&t=web&offset={{offset}}', '', 3, 0, 10),
          ('mojeek', 'https://www.mojeek.com/search?q={{query}}&s={{offset}}', '', 5, 1, 10), ('startpage', 'https://www.startpage.com/sp/search', 'query={{query}}&cat=web&language=english&page={{page}}', 5, 0, 10)),
        t AS (SELECT name, engine, CASE {' '.join(f"WHEN {'engine = ' + quoted(b) if b == 'info' else f'starts_with(engine, {quoted(b)}) AND contains(engine, {quoted(p)})'} THEN {quoted(a)}" for b, p, a, _ in E.TEMPLATES)} END AS tmpl,
          CASE {' '.join(f"WHEN {'engine = ' + quoted(b) if b == 'info' else f'starts_with(engine, {quoted(b)}) AND contains(engine, {quoted(p)})'} THEN {n}" for b, p, _, n in E.TEMPLATES)} END AS pages,
          CASE {' '.join(f"WHEN suffix(engine, {quoted(x)}) THEN {quoted(h)}" for x, h in E.GOOGLE_HOSTS.items())} ELSE 'www.google.com' END AS host FROM i WHERE engine NOT IN (SELECT engine FROM own)),
        a AS (SELECT name, engine, replace(tmpl, '{{host}}', host) AS tmpl, '' AS form, pages, 0 AS first, 10 AS step FROM t WHERE tmpl IS NOT NULL UNION ALL SELECT name, engine, tmpl, form, pages, first, step FROM i JOIN own USING (engine)),
        q AS (SELECT item_id AS query_id, {FIRST_SIX} AS query FROM benchmark),
        r AS (SELECT query_id, name, engine, tmpl, form, first, step, unnest(generate_series(1, pages)) AS page, replace(url_encode(trim(query)), '+', '%20') AS text FROM q CROSS JOIN a),
        n AS (SELECT *, first + (page - 1) * step AS o FROM r),
        f AS (SELECT *, CASE WHEN engine = 'duckduckgo' AND page = 1 THEN 'q={{query}}' ELSE form END AS sent FROM n),
        s AS (SELECT query_id, name, engine, page, replace(replace(replace(replace(tmpl, '{{query}}', text), '{{offset}}', CAST(o AS VARCHAR)), '{{next}}', CAST(o + 1 AS VARCHAR)), '{{page}}', CAST(page AS VARCHAR)) AS address,
                     replace(replace(replace(replace(sent, '{{query}}', text), '{{offset}}', CAST(o AS VARCHAR)), '{{next}}', CAST(o + 1 AS VARCHAR)), '{{page}}', CAST(page AS VARCHAR)) AS form FROM f)
        SELECT query_id, name, engine, page, md5(address) AS md5, md5(form) AS form_md5 FROM s""",
    "serp_dedup": f"WITH {RAW}, {NORM} SELECT norm_url, url, engine, rank_position FROM (SELECT norm_url, raw.url, engine, rank_position, row_number() OVER (PARTITION BY norm_url ORDER BY rank_position, engine, raw.url) AS k FROM raw JOIN norm USING (page_id)) WHERE k = 1",
    "paragraph_dedup": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT doc_id, left({TRIM.format("regexp_replace(lower(line), '[\\s\\p{Z}]+', ' ', 'g')")}, 80) AS f FROM l) SELECT md5(f) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM f WHERE f <> '' GROUP BY f",
    "json_engines": "SELECT page_id, url, 'Page ' || page_id AS title, unnest(['s', 'w']) AS snippet, 1 AS rank_position FROM pages WHERE page_id % 5 <> 0",
    "spoken_answers": rf"""WITH a AS (SELECT conv_id, turn, {PLAIN.format(TRIM.format(f'({SAID})'))} AS t FROM conversations WHERE role = 'assistant'),
        b AS (SELECT *, lower(regexp_extract(t, '^([^\n]*)', 1)) AS line, {TRIM.format("regexp_replace(t, '^[^\n]*', '')")} AS rest FROM a),
        c AS (SELECT conv_id, turn, {TRIM.format(f"CASE WHEN {has('line', L.PREAMBLES)} AND rest <> '' THEN rest ELSE t END")} AS done FROM b),
        d AS (SELECT conv_id, turn, left(replace(replace(replace(replace(replace(done, '**', ''), '##', ''), '`', ''), chr(10) || chr(10), '. '), chr(10), ' '), 5000) AS p FROM c),
        e AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(p, '\[[0-9, ]*\]', '', 'g'), '\[([^\]]*)\]?', '\1', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS said FROM d)
        SELECT conv_id, turn, md5(said) AS md5, length(said) AS n_chars FROM e""",
    "ranked_context": f"""WITH {SOURCES}, m(mode, least, most, budget) AS (VALUES ('lite', 0.05, 30, 16000), ('research', 0.0, 50, 12000)),
        w AS (SELECT *, list_filter(regexp_split_to_array(lower(query), '[\\s\\p{{Z}}]+'), lambda x: strlen(x) > 2 AND NOT list_contains({listed(L.CONTEXT_STOPWORDS)}, x)) AS kw FROM src),
        v AS (SELECT *, CASE WHEN len(kw) = 0 THEN 1.0::FLOAT ELSE CAST(3 * len(list_filter(kw, lambda x: contains(lower(title), x))) + len(list_filter(kw, lambda x: contains(lower(title || ' ' || text), x))) AS FLOAT) / CAST(len(kw) * 4 AS FLOAT) END AS rel FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY rel DESC, source_id) AS k FROM v CROSS JOIN m WHERE rel >= CAST(least AS FLOAT)),
        n AS (SELECT *, count(*) OVER (PARTITION BY mode, query_id) AS n FROM r WHERE k <= most),
        p AS (SELECT *, CASE WHEN n <= 2 THEN k WHEN k % 2 = 1 THEN (k + 1) // 2 ELSE n + 1 - k // 2 END AS place, '[General Web - ' || regexp_extract(url, '^https://([^/]+)', 1) || '] ' || title || ' (' || url || ')' || chr(10) AS head, {TRIM.format('text')} AS body FROM n),
        b AS (SELECT *, strlen(head) + strlen(body) + 6 AS est FROM p),
        o AS (SELECT *, coalesce(sum(est + length(CAST(place AS VARCHAR))) OVER (PARTITION BY mode, query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + est > budget AS over_it FROM b),
        s AS (SELECT *, bool_or(over_it) OVER (PARTITION BY mode, query_id ORDER BY place) AS stopped FROM o),
        c AS (SELECT mode, query_id, string_agg('[' || place || '] ' || head || body || chr(10) || chr(10), '' ORDER BY place) AS context FROM s WHERE NOT stopped GROUP BY mode, query_id)
        SELECT mode, query_id, strlen(context) AS n_bytes, md5(context) AS md5 FROM c""",
    "largest_results": f"WITH {SOURCES} SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY strlen(text) DESC, source_id) AS place FROM src",
    "carried_report": """WITH t AS (SELECT doc_id, CASE WHEN strlen(text) <= 3000 THEN text ELSE '[...truncated...] ' || right(text, list_max(list_filter(generate_series(750, 3000), lambda k: strlen(right(text, k)) <= 3000))) END AS kept FROM documents)
        SELECT doc_id, md5(kept) AS md5, strlen(kept) AS n_bytes, md5('QUERY: q' || chr(10) || chr(10) || 'EXISTING REPORT (summary):' || chr(10) || kept || chr(10) || chr(10) || 'NEW SOURCES (Batch 2/3):' || chr(10) || 'c') AS asked_md5 FROM t""",
    "live_texts": """WITH t AS (SELECT doc_id, text, doc_id % 3 AS f, strlen(text) AS n FROM documents)
        , k AS (SELECT doc_id, CASE WHEN f = 0 AND n > 4000 THEN left(text, list_max(list_filter(generate_series(1000, 4000), lambda k: strlen(left(text, k)) <= 4000))) ELSE text END AS kept FROM t WHERE CASE f WHEN 0 THEN n >= 120 WHEN 1 THEN n >= 10 ELSE n >= 50 END)
        SELECT doc_id, strlen(kept) AS n_bytes, md5(kept) AS md5 FROM k""",
    "retry_choice": f"""WITH a AS (SELECT conv_id, turn, {PLAIN.format(TRIM.format(f'({SAID})'))} AS t FROM conversations WHERE role = 'assistant'),
        b AS (SELECT *, lower(regexp_extract(t, '^([^\\n]*)', 1)) AS line, {TRIM.format("regexp_replace(t, '^[^\\n]*', '')")} AS rest FROM a),
        c AS (SELECT conv_id, turn, {TRIM.format(f"CASE WHEN {has('line', L.PREAMBLES)} AND rest <> '' THEN rest ELSE t END")} AS one FROM b),
        d AS (SELECT *, CASE WHEN (conv_id * 3 + turn) % 3 = 0 THEN left(one, 60) WHEN (conv_id * 3 + turn) % 4 = 0 THEN replace(one || ' more', '[1]', '') ELSE '[' || left(one, 40) END AS two FROM c)
        SELECT conv_id, turn, md5(CASE WHEN strlen(two) > strlen(one) OR (contains(two, '[') AND NOT contains(one, '[')) THEN two ELSE one END) AS md5 FROM d""",
    "query_variations": f"""WITH {QUERIES}, t AS (SELECT query_id, {TRIM.format('query')} AS q FROM q)
        SELECT query_id, md5(CASE WHEN q = '' THEN '' ELSE q || '|' || q || ' news|' || q || ' forum' END) AS general,
        md5(CASE WHEN q = '' THEN '' ELSE q || '|' || q || ' ' || ['programming tutorial', 'research study', 'market analysis', 'medical research', 'latest 2026', 'guide'][query_id % 6 + 1] END) AS specialised FROM t""",
    "query_year_live": f"""WITH {QUERIES}, t AS (SELECT query_id, query || CASE WHEN query_id % 3 = 0 THEN ' latest' ELSE '' END || CASE WHEN query_id % 5 = 0 THEN ' 2024' ELSE '' END AS q FROM q)
        SELECT query_id, md5(CASE WHEN {has('lower(q)', ['latest', 'current', 'recent', 'today', 'new', 'now', 'this year', 'right now', 'as of', 'updated', 'newest'])} AND NOT {has('lower(q)', [str(y) for y in range(2020, 2031)])} THEN q || ' 2026' ELSE q END) AS md5 FROM t""",
    "mode_caps": f"""WITH {QUERIES}, a AS (SELECT query_id, {INTENT} AS intent, CASE WHEN {WORDS} <= 3 THEN 'simple' WHEN {WORDS} <= 8 THEN 'medium' ELSE 'complex' END AS complexity, CASE WHEN query_id % 2 = 0 THEN 40 END AS wish FROM q),
        b AS (SELECT *, CASE WHEN intent = 'factual' THEN CASE WHEN complexity = 'simple' THEN 15 ELSE 20 END WHEN intent = 'comparison' THEN 30 WHEN intent = 'navigational' THEN 10 WHEN intent = 'research' THEN 40 ELSE 25 END AS optimal, least(coalesce(wish, 420), 100) AS usual FROM a),
        c AS (SELECT *, CASE WHEN complexity = 'simple' THEN least(usual, 50) WHEN complexity = 'complex' THEN 100 ELSE usual END AS tuned, unnest(['auto', 'lite', 'fast', 'specialized_tech', 'research', 'reddit']) AS mode FROM b)
        SELECT query_id, mode, CASE WHEN mode IN ('auto', 'lite') THEN CASE WHEN intent = 'navigational' THEN least(tuned, 30) ELSE tuned END WHEN mode = 'fast' THEN least(coalesce(wish, 30), 30) WHEN mode = 'specialized_tech' THEN least(coalesce(wish, 100), 150) ELSE least(coalesce(wish, 420), 900) END AS url_cap,
          CASE WHEN mode = 'research' THEN 200 WHEN mode = 'specialized_tech' THEN 50 ELSE greatest(optimal, 25) END AS chunk_count, least(coalesce(wish, 420), CASE WHEN mode = 'lite' THEN 50 ELSE 900 END) AS live_cap, CASE WHEN mode = 'research' THEN 50 ELSE 25 END AS live_chunks FROM c""",
    "fetch_rules": """WITH t AS (SELECT page_id, unnest([1, 2]) AS attempt FROM pages), n AS (SELECT *, page_id + attempt AS n FROM t),
        o AS (SELECT page_id, attempt, CASE WHEN n % 5 IN (0, 1) THEN 'blocked' WHEN n % 7 = 1 THEN 'skip' ELSE 'read' END AS outcome FROM n)
        SELECT a.page_id, a.attempt FROM o a JOIN o f ON f.page_id = a.page_id AND f.attempt = 1 WHERE a.outcome = 'read' AND (a.attempt = 1 OR f.outcome = 'blocked')""",
    "search_answers": f"""WITH {HITS}, fetched AS (SELECT query_id, least(count(DISTINCT dedup_key), 20) AS deduplicated FROM kept GROUP BY query_id),
        firsts AS (SELECT query_id, url, engine, row_number() OVER (PARTITION BY query_id ORDER BY engine, rank_position, page_id) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id, norm_url ORDER BY engine, rank_position, page_id) AS k FROM hits) WHERE k = 1),
        shown AS (SELECT query_id, string_agg(seq || ' ' || engine || ' ' || url, '|' ORDER BY seq) AS results FROM firsts WHERE seq <= 20 GROUP BY query_id),
        counted AS (SELECT query_id, count(*) AS total_raw, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines FROM hits GROUP BY query_id)
        SELECT item_id AS query_id, CASE WHEN deduplicated > 0 THEN 200 ELSE 404 END AS status, coalesce(total_raw, 0) AS total_raw, coalesce(deduplicated, 0) AS deduplicated, engines,
          md5(CASE WHEN deduplicated > 0 THEN results ELSE '' END) AS results_md5, CASE WHEN deduplicated > 0 THEN '' ELSE 'No results found. Search engines may be unreachable.' END AS error
        FROM benchmark LEFT JOIN counted c ON c.query_id = item_id LEFT JOIN fetched f ON f.query_id = item_id LEFT JOIN shown s ON s.query_id = item_id""",
    "fetch_list": f"""WITH {HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, dedup_key ORDER BY engine, rank_position, page_id) AS k FROM focused),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY engine, rank_position, page_id) AS seq FROM k WHERE k = 1) SELECT query_id, seq, norm_url, engine FROM n WHERE seq <= 15""",
    "live_events": f"""WITH {HITS}, told AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'lite' END AS focus, {TRIM.format(FIRST_SIX)} || CASE WHEN item_id % 4 = 0 THEN ' site:reddit.com' ELSE '' END AS q FROM benchmark),
        asked AS (SELECT *, CASE WHEN {has('lower(q)', ['latest', 'current', 'recent', 'today', 'new', 'now', 'this year', 'right now', 'as of', 'updated', 'newest'])} AND NOT {has('lower(q)', [str(y) for y in range(2020, 2031)])} THEN q || ' 2026' ELSE q END AS asked, CASE WHEN focus = 'lite' THEN 50 ELSE 420 END AS cap FROM told),
        raw_n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id), adr AS (SELECT query_id, count(DISTINCT dedup_key) AS n FROM focused GROUP BY query_id), shown AS (SELECT query_id, count(DISTINCT norm_url) AS n FROM hits GROUP BY query_id),
        read AS (SELECT h.query_id, count(*) AS n FROM hits h JOIN pages p USING (page_id) JOIN asked a ON a.query_id = h.query_id WHERE h.engine = 'google' AND strlen(p.html) % 200 >= CASE WHEN focus = 'reddit' THEN 10 WHEN focus = 'lite' THEN 100 ELSE 50 END GROUP BY h.query_id),
        a AS (SELECT asked.*, coalesce(raw_n.n, 0) AS raw_hits, least(coalesce(adr.n, 0), cap) AS addresses, least(coalesce(shown.n, 0), cap) AS shown, coalesce(read.n, 0) AS pages FROM asked LEFT JOIN raw_n USING (query_id) LEFT JOIN adr USING (query_id) LEFT JOIN shown USING (query_id) LEFT JOIN read USING (query_id)),
        s AS (SELECT query_id, 1 AS seq, 'info' AS kind, -1 AS n, 'started' AS t FROM a UNION ALL SELECT query_id, 2, 'info', -1, 'searching: ' || asked FROM a UNION ALL SELECT query_id, 3, 'info', raw_hits, 'hits' FROM a UNION ALL SELECT query_id, 4, 'info', addresses, 'addresses' FROM a
              UNION ALL SELECT query_id, 5, 'search_hits', shown, '' FROM a UNION ALL SELECT query_id, 6, 'ranked_chunks', least(pages, 25), '' FROM a WHERE focus = 'lite' UNION ALL SELECT query_id, 7, 'scrape_complete', CASE WHEN focus = 'lite' THEN least(pages, 25) ELSE pages END, '' FROM a)
        SELECT query_id, seq, kind, n, md5(t) AS md5 FROM s""",
    "proxy_turns": "SELECT page_id, ['http://a:1', 'http://b:2', 'http://c:3', 'socks5h://127.0.0.1:9050', 'socks5h://127.0.0.1:9051'][page_id % 5 + 1] AS proxy FROM pages",
    "model_list": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a' || page_id || ',z' || page_id ELSE 'b' || page_id || ',g' || page_id END AS models FROM pages",
    "silent_queries": f"WITH {CHUNKS}, f AS (SELECT doc_id AS source_id, i - 1 AS n, row_number() OVER (ORDER BY doc_id, i) AS mmr_rank FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM chunked)) SELECT q AS query_id, source_id, n, mmr_rank FROM f CROSS JOIN (SELECT item_id AS q FROM benchmark) WHERE mmr_rank <= 10",
    "passage_scores": f"""WITH {CHUNKS}, e AS (SELECT doc_id, c, i, CAST(floor(length(c[i - 1]) * 0.15) AS INT) AS n FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM chunked)),
        w AS (SELECT *, {TRIM.format("CASE WHEN contains(right(c[i - 1], n), ' ') THEN substr(right(c[i - 1], n), strpos(right(c[i - 1], n), ' ')) ELSE right(c[i - 1], n) END")} AS lead FROM e),
        o AS (SELECT doc_id, i - 1 AS place, CASE WHEN i = 1 OR n <= 10 OR lead = '' THEN c[i] ELSE lead || '… ' || c[i] END AS chunk FROM w),
        terms AS (SELECT item_id AS query_id, lower({FIRST_SIX}) AS phrase, unnest(list_distinct({tokens(FIRST_SIX)})) AS term FROM benchmark), split AS (SELECT doc_id, place, chunk, {tokens('chunk')} AS t FROM o WHERE {TRIM.format('chunk')} <> ''),
        sizes AS (SELECT count(*) AS n, greatest(sum(len(t)), 1) / greatest(count(*), 1) AS avgdl FROM split), each AS (SELECT doc_id, place, len(t) AS dl, unnest(t) AS term FROM split),
        counted AS (SELECT doc_id, place, term, count(*) AS tf, any_value(dl) AS dl FROM each WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, place, term), freq AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
        bm AS (SELECT query_id, phrase, doc_id, place, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl)) + 1.0)) AS bm25 FROM terms JOIN counted USING (term) JOIN freq USING (term) CROSS JOIN sizes GROUP BY query_id, phrase, doc_id, place),
        votes AS (SELECT doc_id, (1.5 + CAST(CAST(0.8 AS FLOAT) AS DOUBLE)) / (60.0 + doc_id % 40 + 1) AS rrf FROM documents WHERE doc_id % 3 = 0),
        named AS (SELECT doc_id, lower(array_to_string(regexp_split_to_array(text, '\\s+')[1:4], ' ')) AS title FROM documents), per AS (SELECT query_id, list(term) AS ts FROM terms GROUP BY query_id),
        scored AS (SELECT query_id, doc_id, place, chunk, round((bm25 + CASE WHEN phrase <> '' AND contains(lower(chunk), phrase) THEN 1.25 ELSE 0 END + 0.5 * len(list_filter(ts, lambda x: contains(title, x)))) * (1 + 0.5 * coalesce(rrf, 0) / (SELECT max(rrf) FROM votes)) + 0.05 * (0.7 - 0.5), 9) AS score
                   FROM (SELECT query_id, phrase, doc_id, place, coalesce(bm25, 0) AS bm25 FROM (SELECT DISTINCT query_id, phrase FROM terms) CROSS JOIN (SELECT doc_id, place FROM split) LEFT JOIN bm USING (query_id, phrase, doc_id, place)) bm JOIN split USING (doc_id, place) JOIN named USING (doc_id) JOIN per USING (query_id) LEFT JOIN votes USING (doc_id)),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(chunk) DESC, doc_id, place) AS k FROM scored)
        SELECT query_id, doc_id AS source_id, place AS n, round(score, 6) AS score FROM best WHERE k <= 10""",
    "iterative_reports": """WITH o AS (SELECT conv_id, list(text ORDER BY turn, text) AS b FROM conversations GROUP BY conv_id),
        r AS (SELECT conv_id, list_reduce(b, lambda s, x: CASE WHEN s = '' THEN x ELSE right(s, 200) || chr(10) || x END) AS report FROM o) SELECT conv_id, md5(report) AS md5, length(report) AS n_chars FROM r""",
}
#: Streams give what their tables do.
SQL |= {"session_stream": SQL["session_ttl"], "batch_stream": SQL["count_or_timeout_batches"], "deadline_stream": SQL["deadline_filter"], "cooldown_stream": SQL["cooldown_state"], "fetch_list_stream": SQL["fetch_list"]}
SQL["asked_engines"] = """
WITH s(mode, names) AS (VALUES
    ('primary', 'wikipedia duckduckgo brave yahoo bing google qwant startpage mojeek ecosia wiby'),
    ('backup', 'bing_news google_news brave_news yahoo_news yandex ask dogpile excite webcrawler presearch yep mwmbl marginalia stract bing_us bing_uk google_us google_uk alexandria 4get whoogle librex yacy mullvad_leta'),
    ('tech', 'duckduckgo brave google bing startpage qwant google_news bing_news marginalia stract wiby'),
    ('science', 'wikipedia google google_scholar brave duckduckgo startpage mojeek bing ecosia qwant'),
    ('finance', 'google google_news bing bing_news yahoo yahoo_news brave brave_news duckduckgo startpage'),
    ('health', 'google wikipedia bing duckduckgo brave google_scholar mojeek startpage ecosia qwant'),
    ('news', 'google_news bing_news brave_news yahoo_news duckduckgo_news google bing brave yahoo duckduckgo'),
    ('unheard of', 'wikipedia duckduckgo brave google bing yahoo qwant startpage mojeek ecosia')),
  a AS (SELECT mode, string_split(names, ' ') AS names FROM s UNION ALL SELECT 'all', (SELECT string_split(names, ' ') FROM s WHERE mode = 'primary') || (SELECT string_split(names, ' ') FROM s WHERE mode = 'backup')),
  q AS (SELECT item_id AS query_id, ['all', 'tech', 'science', 'finance', 'health', 'news', 'primary', 'backup', 'unheard of'][item_id % 9 + 1] AS mode FROM benchmark),
  e AS (SELECT query_id, mode, unnest(names) AS engine, CAST(unnest(generate_series(0, len(names) - 1)) AS INT) AS ord FROM q JOIN a USING (mode))
SELECT query_id, mode, ord, engine,
       CAST(CAST(CASE WHEN engine IN ('google', 'bing', 'duckduckgo', 'brave', 'wikipedia') THEN 1.5 WHEN engine IN ('startpage', 'qwant', 'mojeek', 'yahoo', 'yandex', 'ecosia') THEN 1.2
         WHEN engine IN ('dogpile', 'webcrawler', 'excite', 'wiby', 'marginalia', 'mwmbl', 'stract', '4get', 'whoogle', 'librex', 'yacy', 'mullvad_leta', 'alexandria') THEN 0.8 ELSE 1.0 END AS FLOAT) AS DOUBLE) AS weight FROM e"""
SQL["fetch_addresses"] = f"SELECT query_id, seq, regexp_replace(norm_url, '://(www\\.)?reddit\\.com', '://old.reddit.com') AS address FROM ({SQL['fetch_list']})"
SQL["page_texts"] = """
WITH v AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, page_id % 6 AS kind, unnest([false, true]) AS live FROM pages),
  t AS (SELECT *, ' of page ' || n || ', which says enough about its matter to be taken for an article by any reader of it.' AS said,
               'Shown in short for page ' || n || chr(10) || chr(10) || 'Found by those who look for ' || n AS head FROM v),
  w AS (SELECT *, CASE WHEN kind IN (0, 1) THEN 'json_ld' WHEN kind = 2 THEN 'semantic' WHEN kind = 3 OR (kind = 4 AND NOT live) THEN 'meta' WHEN kind = 4 THEN 'elements' ELSE 'body' END AS strategy,
               CASE kind WHEN 0 THEN 'The body' || said WHEN 1 THEN 'Description' || said WHEN 2 THEN 'Paragraph' || said WHEN 3 THEN head WHEN 4 THEN CASE WHEN live THEN 'Only a line of ' || n ELSE head END ELSE 'Hardly a word, ' || n END AS text FROM t)
SELECT page_id, live, CASE WHEN live THEN 'Page ' || n ELSE 'Page ' || n || ' - Site | More' END AS title, strategy, md5(text) AS md5, strlen(text) >= CASE WHEN live THEN 10 ELSE 50 END AS kept FROM w"""
SQL["whole_report"] = f"""
WITH h AS (SELECT 'engine_' || user_id % 8 AS engine, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT (SELECT max(epoch_us(ts)) FROM events) AS generated_at, '1' AS version, g.*, e.latency_p50, e.latency_p95, e.latency_p99, (SELECT round(avg(value), 6) FROM events) AS latency_mean,
       (SELECT string_agg(engine || ' ' || total || ' ' || succeeded || ' ' || failed, '|' ORDER BY engine) FROM h) AS engine_health,
       e.engine_hit_ratio, e.scrape_hit_ratio, e.answer_hit_ratio, 0.7::DOUBLE AS avg_extraction_confidence
FROM ({SQL['golden_report']}) g, ({SQL['eval_report']}) e"""
SQL["session_store"] = """
WITH e AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, event_type, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'wipe' WHEN 'error' THEN 'get' ELSE 'update' END AS c FROM events
), s AS (
  SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM e WHERE c <> 'get'
), b AS (
  SELECT *, sum(CASE WHEN c IN ('create', 'wipe') OR before IS NULL OR us - before >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS g FROM s
), x AS (
  SELECT *, first_value(c) OVER w AS began, count(*) OVER w - 1 AS updates FROM b WINDOW w AS (PARTITION BY user_id, g ORDER BY us, event_id)
), a AS (
  SELECT e.*, last_value(CASE WHEN x.c IS NOT NULL THEN {'began': x.began, 'updates': x.updates, 'status': x.event_type, 'us': x.us} END IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.us, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
  FROM e LEFT JOIN x ON x.user_id = e.user_id AND x.event_id = e.event_id
), f AS (
  SELECT *, coalesce(l.began = 'create' AND us - l.us < 86400000000, false) AS found FROM a WHERE c = 'get'
)
SELECT user_id, event_id, found, CASE WHEN found THEN l.status ELSE '' END AS status, (CASE WHEN found THEN l.updates ELSE -1 END)::BIGINT AS updates FROM f"""
SQL["stored_results"] = r"""
WITH e AS (SELECT page_id, regexp_replace(url, '^https?:', 'https:') AS u, unnest(['yahoo', 'mojeek', 'bing']) AS engine FROM pages)
SELECT page_id, engine, 1 AS page, 1 AS rank_position, u AS url, 'Title one ' || page_id AS title, 'Said of one ' || page_id AS snippet FROM e
UNION ALL SELECT page_id, engine, 1, 2, 'https://two.example/' || page_id, 'Title two ' || page_id, 'Said of two ' || page_id FROM e
UNION ALL SELECT page_id, engine, 2, 1, u, 'Other title ' || page_id, 'Other words ' || page_id FROM e
UNION ALL SELECT page_id, engine, 2, 2, 'https://three.example/' || page_id, 'Title three ' || page_id, 'Said of three ' || page_id FROM e"""
