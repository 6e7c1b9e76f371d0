"""SQL for the same answers, run by DuckDB on the same tables."""

from marginalia.functions.stopwords import BASE_EN, CLOUD_EN, STOP_ZH

LIBRARY = r"""
texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS seq, split_part(text, chr(10), 1) AS title,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS article_preview, text AS content,
         source AS source_file_id, source || '.csv' AS source_file_name, lang AS detected_language
  FROM documents),
library AS (
  SELECT t.id, t.seq, t.title, coalesce(p.url, '#') AS url, t.article_preview, t.content, t.source_file_id,
         t.source_file_name, t.detected_language,
         list_filter([CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN ' toxic' END,
                      t.detected_language], lambda x: x IS NOT NULL) AS tags,
         'https://www.instapaper.com/read/' || t.id AS instapaper_url, 'instapaper' AS provider,
         coalesce(l.quality = 1, false) AS is_favorite,
         CASE WHEN l.toxic = 1
              THEN '2024-01-' || lpad(CAST(t.seq % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z' END AS deleted_at
  FROM texts t LEFT JOIN labels l ON l.doc_id = t.seq LEFT JOIN pages p ON p.page_id = t.seq),
active AS (SELECT * FROM library WHERE coalesce(deleted_at, '') = '')"""

SOURCES = r"""
sources AS (
  SELECT source AS id, min(doc_id) AS pos, source || '.csv' AS name FROM documents GROUP BY source
  UNION ALL SELECT 'unused', count(*), 'unused.csv' FROM region)"""


# Latin letters and what stands for them where a query needs a text in Han characters.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HAN = "".join(chr(0x4E00 + 64 * k) for k in range(len(LETTERS)))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def domain_sql(url: str, fallback: str = "") -> str:
    low, raw = f"lower(trim({url}))", f"trim({url})"
    host = (
        rf"regexp_extract({low}, '^[a-z]+:[/\\]*(?:[^/\\?#]*@)?(\[[0-9a-f:.]+\]|[^/\\?#:@\s<>^|%\[\]]+)"
        rf"(?::[0-9]{{0,5}})?(?:[/\\?#]|$)', 1)"
    )
    other = rf"regexp_extract({raw}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)"
    return (
        f"CASE WHEN regexp_matches({low}, '^(?:https?|ftp|wss?):') THEN CASE WHEN {host} = '' THEN '{fallback}' "
        rf"ELSE regexp_replace({host}, '^www\.', '') END "
        rf"WHEN regexp_matches({low}, '^[a-z][a-z0-9+.\-]*:') THEN regexp_replace({other}, '^www\.', '') "
        f"ELSE '{fallback}' END"
    )


def stem_sql(w: str) -> str:
    return f"""CASE WHEN length({w}) < 4 THEN {w}
      WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3)
      WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'
      WHEN {w} LIKE '%es' AND length({w}) > 4 THEN left({w}, length({w}) - 2)
      WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1)
      WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN left({w}, length({w}) - 2) ELSE {w} END"""


def noise_sql(w: str, stop) -> str:
    return f"(length({w}) < 2 OR regexp_matches({w}, '^[0-9]+$') OR {w} IN ({quoted(stop)}))"


# The same word boundaries in RE2 syntax. The tables hold no Han or kana, so those runs are left out.
_LETTER = r"(?:[^\P{L}\p{Han}\x{3040}-\x{30ff}]|\p{M}|\p{Nl})"
_WORD = (
    rf"(?:{_LETTER}+(?:[''‘’.․＇．··‧]{_LETTER}+)*"
    r"|\p{Nd}+(?:[''‘’.․＇．,;٬]\p{Nd}+)*|_)+"
)


def words_sql(rows: str) -> str:
    return f"""
words AS (
  SELECT seq, unnest(list) AS w, generate_subscripts(list, 1) - 1 AS pos
  FROM (SELECT seq, regexp_extract_all(lower(title || ' ' || article_preview), '{_WORD}') AS list FROM {rows})),
bases AS (SELECT seq, pos, w, CASE WHEN w LIKE '%''s' THEN left(w, length(w) - 2) ELSE w END AS b FROM words)"""


def terms_sql(rows: str, stop=BASE_EN) -> str:
    """CTEs up to ``terms(seq, pos, term)`` and ``postings(seq, term, tf)``."""
    return f"""{words_sql(rows)},
terms AS (
  SELECT seq, pos, CASE WHEN regexp_matches(b, '^[a-z0-9'']+$')
                THEN CASE WHEN NOT {noise_sql("b", stop)} THEN {stem_sql("b")} END
                WHEN length(b) >= 2 AND b NOT IN ({quoted(STOP_ZH)}) THEN b END AS term
  FROM bases),
postings AS (SELECT seq, term, count(*) AS tf FROM terms WHERE term IS NOT NULL GROUP BY seq, term)"""


def idf_sql(rows: str) -> str:
    return f"""{terms_sql(rows)},
idfs AS (SELECT term, count(*) AS df, ln(1 + (SELECT count(*) FROM {rows}) / (1.0 + count(*))) AS idf
         FROM postings GROUP BY term)"""


def contains_sql(column: str, text: str) -> str:
    return f"contains(lower(coalesce({column}, '')), '{text}')"


def term_score_sql(text: str, url_only: bool = False) -> str:
    url = f"CASE WHEN {contains_sql('url', text)} THEN 3 ELSE 0 END"
    if url_only:
        return f"({url})"
    return (
        f"(CASE WHEN {contains_sql('title', text)} THEN 10 ELSE 0 END"
        f" + CASE WHEN {contains_sql('article_preview', text)} THEN 5 ELSE 0 END + {url}"
        f" + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), '{text}'))) > 0 THEN 8 ELSE 0 END)"
    )


def search_sql(*terms, favorites: bool = False) -> str:
    scores = [term_score_sql(*t) for t in terms]
    where = " AND ".join([f"{s} > 0" for s in scores] + (["is_favorite"] if favorites else []))
    total = " + ".join(scores) if scores else "CAST(NULL AS INTEGER)"
    return f"WITH {LIBRARY} SELECT id, {total} AS score FROM active WHERE {where}"


def select(columns: str, rows: str = "active", where: str = "true") -> str:
    return f"WITH {LIBRARY} SELECT {columns} FROM {rows} WHERE {where}"


def ranked_sql(scores: str, extra: str = "") -> str:
    return f"""SELECT t.id, t.seq, round(s.score, 6) AS score{extra}
  FROM ({scores}) s JOIN texts t ON t.seq = s.seq WHERE t.id <> '{TARGET}' ORDER BY s.score DESC, t.seq LIMIT 5"""


TARGET = "7"

_OWN = f"own AS (SELECT term, tf FROM postings WHERE seq = {TARGET})"

_SUMS = f"""{_OWN},
sums AS (
  SELECT t.seq,
         coalesce(sum(p.tf * coalesce(o.tf, 0)), 0) AS dot, coalesce(sum(p.tf * p.tf), 0) AS sq,
         coalesce(sum(p.tf * coalesce(o.tf, 0) * i.idf * i.idf), 0) AS doti,
         coalesce(sum(p.tf * p.tf * i.idf * i.idf), 0) AS sqi
  FROM texts t LEFT JOIN postings p ON p.seq = t.seq LEFT JOIN idfs i ON i.term = p.term
       LEFT JOIN own o ON o.term = p.term
  GROUP BY t.seq),
owns AS (SELECT sum(o.tf * o.tf) AS sq, sum(o.tf * o.tf * i.idf * i.idf) AS sqi
         FROM own o JOIN idfs i ON i.term = o.term),
cosines AS (
  SELECT s.seq,
         CASE WHEN s.sq = 0 OR w.sq = 0 THEN 0 ELSE s.dot / (sqrt(s.sq) * sqrt(w.sq)) END AS tf,
         CASE WHEN s.sqi = 0 OR w.sqi = 0 THEN 0 ELSE s.doti / (sqrt(s.sqi) * sqrt(w.sqi)) END AS tfidf
  FROM sums s CROSS JOIN owns w),
shares AS (
  SELECT CASE WHEN (SELECT count(*) FROM texts) >= 20 AND max(idf) - min(idf) >= 1
              THEN 1 / (1 + exp(-((min(idf) + max(idf)) / 2
                   - (SELECT avg(i.idf) FROM own o JOIN idfs i ON i.term = o.term)) * 4))
              ELSE 0 END AS share FROM idfs)"""

_CORPUS = f"WITH {LIBRARY}, {idf_sql('texts')}, {_SUMS}"


def graph_sql(weight: str, limit: str = "LIMIT 50", recursive: str = "") -> str:
    return f"""WITH {recursive} {LIBRARY},
picked AS (SELECT * FROM active ORDER BY seq {limit}), {idf_sql('picked')},
vectors AS (SELECT p.seq, p.term, {weight} AS w FROM postings p JOIN idfs i ON i.term = p.term),
norms AS (SELECT seq, sqrt(sum(w * w)) AS n FROM vectors GROUP BY seq),
edges AS (
  SELECT a.seq AS src, b.seq AS dst, sum(a.w * b.w) / (max(na.n) * max(nb.n)) AS value
  FROM vectors a JOIN vectors b ON a.term = b.term AND a.seq < b.seq
       JOIN norms na ON na.seq = a.seq JOIN norms nb ON nb.seq = b.seq
  GROUP BY a.seq, b.seq HAVING sum(a.w * b.w) / (max(na.n) * max(nb.n)) > 0.15)"""


def _term_sql(count: str) -> str:
    return f"CASE WHEN {count} > 0 THEN ({count}) * ln({count}) ELSE 0 END"


COLLOCATIONS = f"""WITH {LIBRARY}, {words_sql('active')},
content AS (SELECT seq, pos, CASE WHEN regexp_matches(w, '^[a-z0-9'']+$') AND NOT {noise_sql("w", CLOUD_EN)} THEN w END AS c FROM words),
pairs AS (SELECT x.seq, x.pos, x.c AS a, y.c AS b FROM content x JOIN content y ON y.seq = x.seq AND y.pos = x.pos + 1 WHERE x.c <> y.c),
counts AS (SELECT a, b, count(*)::DOUBLE AS k FROM pairs GROUP BY a, b),
firsts AS (SELECT a, sum(k) AS r FROM counts GROUP BY a), seconds AS (SELECT b, sum(k) AS c FROM counts GROUP BY b),
tables AS (SELECT a, b, k, r, c, (SELECT sum(k) FROM counts) AS n FROM counts JOIN firsts USING (a) JOIN seconds USING (b)),
known AS (SELECT a, b, k::BIGINT AS cnt, ratio FROM (
    SELECT *, 2 * ({_term_sql("k")} + {_term_sql("r - k")} + {_term_sql("c - k")} + {_term_sql("n - r - c + k")}
                   - {_term_sql("r")} - {_term_sql("n - r")} - {_term_sql("c")} - {_term_sql("n - c")} + {_term_sql("n")}) AS ratio FROM tables)
  WHERE ratio >= 10.83 AND k * n > r * c AND k >= 2)"""


def read_oracles() -> dict[str, str]:
    """Searches, counts, terms, similarity and the graph."""
    pages = f"(SELECT page_id AS seq, {domain_sql('url')} AS domain FROM pages)"
    top = f"""SELECT domain, count(*) AS cnt, min(seq) AS first_seq FROM {pages}
              WHERE domain <> '' GROUP BY domain ORDER BY cnt DESC, first_seq LIMIT 15"""
    degrees = "SELECT src AS seq FROM edges UNION ALL SELECT dst FROM edges"
    both_ways = "SELECT src, dst, value FROM edges UNION ALL SELECT dst, src, value FROM edges"
    cloud = f"""
      WITH {LIBRARY}, {terms_sql('active', CLOUD_EN)},
      counts AS (SELECT term, count(*) AS cnt, min(seq * 8388608 + pos) AS seen
                 FROM terms WHERE term IS NOT NULL GROUP BY term),
      top AS (SELECT * FROM counts ORDER BY cnt DESC, seen LIMIT 60)"""
    contained = " OR ".join(
        f"contains(lower({c}), word)" for c in ("title", "article_preview", "url")
    ) + " OR len(list_filter(tags, lambda t: contains(lower(t), word))) > 0"
    return {
        "domain_counts": f"SELECT domain, count(*) AS cnt FROM {pages} WHERE domain <> '' GROUP BY domain",
        "top_domains": top,
        "domain_share": f"""SELECT domain, cnt, CAST(floor(cnt * 100.0 / max(cnt) OVER () + 0.5) AS BIGINT) AS share
                            FROM ({top})""",
        "trash_split": f"""WITH {LIBRARY} SELECT count(*) FILTER (WHERE coalesce(deleted_at, '') = '') AS active,
                           count(*) FILTER (WHERE coalesce(deleted_at, '') <> '') AS trashed FROM library""",
        "folder_counts": f"""WITH {LIBRARY}, {SOURCES} SELECT s.id, s.name, count(a.id) AS cnt
                             FROM sources s LEFT JOIN active a ON a.source_file_id = s.id GROUP BY s.id, s.name""",
        "source_count": f"WITH {SOURCES} SELECT count(*) AS sources FROM sources",
        "tag_counts": f"""WITH {LIBRARY}, tags AS (
                            SELECT seq, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM library)
                          SELECT trim(tag) AS tag, count(*) AS cnt, min(seq * 8388608 + pos) // 8388608 AS first_seq, min(seq * 8388608 + pos) % 8388608 AS first_pos
                          FROM tags WHERE trim(tag) <> '' GROUP BY trim(tag)""",
        "folder_name": f"WITH {SOURCES} SELECT coalesce(max(name), 'unknown') AS name FROM sources WHERE id = 'src3'",
        "view_active": select("id, title, url"),
        "view_folder": select("id, title, url", where="source_file_id = 'src3'"),
        "view_language": select("id, title", where="detected_language = 'en'"),
        "view_language_other": select("id, detected_language", where="detected_language NOT IN ('en', 'zh', 'ja')"),
        "view_tag": select("id, title", where="list_contains(tags, 'quality')"),
        "view_first_50": f"WITH {LIBRARY} SELECT id, title FROM active ORDER BY seq LIMIT 50",
        "view_combined": f"""WITH {LIBRARY} SELECT id, {term_score_sql('tion')} AS score FROM active
                             WHERE source_file_id = 'src3' AND detected_language = 'en'
                             AND {term_score_sql('tion')} > 0""",
        "search_keywords": search_sql(("tion",), ("the",)),
        "search_phrase": search_sql(("of the",)),
        "search_link": search_sql(("example.com", True)),
        "search_favorites": search_sql(("tion",), favorites=True),
        "search_favorites_only": search_sql(favorites=True),
        "sort_newer": select("id, seq, row_number() OVER (ORDER BY CAST(id AS DOUBLE) DESC, seq) AS rank"),
        "sort_older": select("id, seq, row_number() OVER (ORDER BY CAST(id AS DOUBLE), seq) AS rank"),
        "sort_relevance": f"""SELECT s.id, s.score, row_number() OVER (ORDER BY s.score DESC, CAST(s.id AS BIGINT)) AS rank
                              FROM ({search_sql(("tion",), ("the",))}) s""",
        "sort_random": select("id"),
        "trash_list": select(
            "id, deleted_at, row_number() OVER (ORDER BY deleted_at DESC, seq) AS rank",
            "library",
            "coalesce(deleted_at, '') <> ''",
        ),
        "point_lookup": select("id, title", "library", "id = '7'"),
        "all_selected": f"""WITH {LIBRARY} SELECT count(*) > 0 AND bool_and(a.source_file_id = 'src3') AS all_selected
                            FROM active a WHERE a.source_file_id = 'src3'""",
        "select_all": select("id", where="detected_language = 'en'"),
        "words": f"""WITH {LIBRARY}, {words_sql('texts')} SELECT w AS word, count(*) AS cnt FROM words GROUP BY w""",
        "stems": f"""WITH {LIBRARY}, {words_sql('texts')}
                     SELECT w AS word, {stem_sql('w')} AS stem FROM (SELECT DISTINCT w FROM words)""",
        "legacy_tokens": f"""
          WITH {LIBRARY}, pieces AS (
            SELECT unnest(string_split(regexp_replace(lower(title || ' ' || article_preview),
                   '[^a-z0-9_一-龥぀-ヿ]+', ' ', 'g'), ' ')) AS p FROM texts)
          SELECT {stem_sql('p')} AS token, count(*) AS cnt FROM pieces
          WHERE regexp_matches(p, '^[a-z0-9]+$') AND NOT {noise_sql('p', CLOUD_EN)} GROUP BY 1""",
        "detect_language": f"""
          WITH {LIBRARY}, counted AS (
            SELECT id, len(regexp_extract_all(title || ' ' || article_preview, '[぀-ヿ]')) AS kana,
                   len(regexp_extract_all(title || ' ' || article_preview, '[一-龥]')) AS han FROM texts)
          SELECT id, CASE WHEN kana > 3 THEN 'ja' WHEN han > 3 THEN 'zh' ELSE 'en' END AS language FROM counted""",
        "term_frequency": f"WITH {LIBRARY}, {terms_sql('texts')} SELECT seq, term, tf FROM postings",
        "cloud_term_counts": f"""WITH {LIBRARY}, {terms_sql('active', CLOUD_EN)}
                                 SELECT term AS word, count(*) AS cnt FROM terms WHERE term IS NOT NULL GROUP BY term""",
        "zh_words": f"""WITH {LIBRARY},
            lines AS (SELECT regexp_replace(translate(lower(left(content, 500)), '{LETTERS} ', '{HAN}'), '[^一-龥]', ' ', 'g') AS t FROM texts),
            marked AS (SELECT '^' || unnest(regexp_extract_all(t, '[一-龥]+')) || '$' AS m FROM lines),
            sized AS (SELECT m, unnest(range(1, 6)) AS n FROM marked),
            pieces AS (SELECT n, substr(m, unnest(range(1, length(m) - n + 2)), n) AS gram FROM sized),
            counts AS (SELECT gram, n, count(*) AS cnt FROM pieces WHERE gram NOT IN ('^', '$') GROUP BY gram, n),
            plain AS (SELECT * FROM counts WHERE NOT contains(gram, '^') AND NOT contains(gram, '$')),
            cut AS (SELECT gram, n, cnt, unnest(range(1, n)) AS at_ FROM plain WHERE n BETWEEN 2 AND 4),
            told AS (SELECT c.gram, c.n, c.cnt, min(ln(c.cnt::DOUBLE * (SELECT sum(cnt) FROM plain WHERE n = 1) / l.cnt / r.cnt)) AS information
                     FROM cut c JOIN plain l ON l.gram = left(c.gram, at_) JOIN plain r ON r.gram = substr(c.gram, at_ + 1) GROUP BY ALL),
            sides AS (SELECT substr(gram, 2) AS gram, 'before' AS side, cnt FROM counts WHERE n > 1
                      UNION ALL SELECT left(gram, n - 1), 'behind', cnt FROM counts WHERE n > 1),
            spread AS (SELECT gram, side, ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) AS entropy FROM sides GROUP BY gram, side)
            SELECT t.gram, t.n::INTEGER AS n, t.cnt, round(information, 6) AS information, round(b.entropy, 6) AS before, round(e.entropy, 6) AS behind
            FROM told t JOIN spread b ON b.gram = t.gram AND b.side = 'before' JOIN spread e ON e.gram = t.gram AND e.side = 'behind'
            WHERE t.cnt >= 5 AND information >= 2.0 AND least(b.entropy, e.entropy) >= 0.7""",
        "search_indexed": search_sql(("tion",), ("the",)),
        "collocations": f"{COLLOCATIONS} SELECT a, b, cnt, round(ratio, 6) AS ratio FROM known",
        "phrase_counts": f"""{COLLOCATIONS},
            found AS (SELECT p.*, pos - row_number() OVER (PARTITION BY seq ORDER BY pos) AS run FROM pairs p JOIN known USING (a, b)),
            runs AS (SELECT seq, first(a ORDER BY pos) || ' ' || string_agg(b, ' ' ORDER BY pos) AS phrase, (count(*) + 1)::INTEGER AS words FROM found GROUP BY seq, run)
            SELECT phrase, words, count(*) AS cnt, min(seq) AS first_seq FROM runs GROUP BY phrase, words""",
        "keyword_pair_counts": f"""
          WITH {LIBRARY}, {words_sql('active')},
          content AS (SELECT seq, pos, CASE WHEN regexp_matches(w, '^[a-z0-9'']+$') AND NOT {noise_sql('w', CLOUD_EN)}
                                       THEN w END AS w FROM words),
          following AS (SELECT w, lead(w) OVER (PARTITION BY seq ORDER BY pos) AS v FROM content)
          SELECT key, display, count(*) AS cnt FROM (
            SELECT {stem_sql('w')} AS key, w AS display FROM content WHERE w IS NOT NULL
            UNION ALL
            SELECT ({stem_sql('w')}) || ' ' || ({stem_sql('v')}), w || ' ' || v FROM following
            WHERE w IS NOT NULL AND v IS NOT NULL AND w <> v) GROUP BY key, display""",
        "idf_table": f"WITH {LIBRARY}, {idf_sql('texts')} SELECT term, df, round(idf, 6) AS idf FROM idfs",
        "word_cloud": f"""{cloud} SELECT term AS word, cnt,
                          round(0.75 + cnt * 1.5 / max(cnt) OVER (), 6) AS size_ratio FROM top""",
        "matches_per_word": f"""{cloud} SELECT term AS word, count(*) AS matches
                                FROM (SELECT term, term AS word FROM top) t JOIN active ON {contained} GROUP BY term""",
        "most_similar_tf": f"{_CORPUS} {ranked_sql('SELECT seq, tf AS score FROM cosines')}",
        "most_similar_tfidf": f"{_CORPUS} {ranked_sql('SELECT seq, tfidf AS score FROM cosines')}",
        "most_similar_auto": f"""{_CORPUS} {ranked_sql(
            "SELECT seq, (1 - share) * tf + share * tfidf AS score, share FROM cosines CROSS JOIN shares",
            ", round(share, 6) AS share, CASE WHEN share < 0.3 THEN 'tf' WHEN share > 0.7 THEN 'tfidf' "
            "ELSE 'blend' END AS mode")}""",
        "pair_similarity": f"{_CORPUS} SELECT round(tf, 6) AS score FROM cosines WHERE seq = 11",
        "graph_nodes": f"""WITH {LIBRARY} SELECT seq, id, title, url, {domain_sql('url', 'unknown')} AS domain, array_to_string(tags, '|') AS tags
                           FROM active ORDER BY seq LIMIT 50""",
        "graph_domains": f"""WITH {LIBRARY} SELECT DISTINCT {domain_sql('url', 'unknown')} AS domain
                             FROM (SELECT * FROM active ORDER BY seq LIMIT 50)""",
        "graph_edges_tf": f"{graph_sql('p.tf')} SELECT src, dst, round(value, 6) AS value FROM edges",
        "graph_edges_tfidf": f"{graph_sql('p.tf * i.idf')} SELECT src, dst, round(value, 6) AS value FROM edges",
        "graph_degree": f"""{graph_sql('p.tf')}, ends AS ({degrees})
                            SELECT p.seq, count(e.seq) AS degree,
                                   round(greatest(8, 4 + sqrt(count(e.seq)) * 4), 6) AS radius,
                                   round(greatest(10, 6 + sqrt(count(e.seq)) * 4), 6) AS label_offset
                            FROM picked p LEFT JOIN ends e ON e.seq = p.seq GROUP BY p.seq""",
        "graph_edges_at": f"""{graph_sql('p.tf')} SELECT src, dst, round(value, 6) AS value,
                              least(4.0, greatest(1.0, value)) AS width FROM edges WHERE src = 7 OR dst = 7""",
        "graph_neighbours": f"""{graph_sql('p.tf', '')}, ends AS ({both_ways}),
                                 ranked AS (SELECT src, (row_number() OVER (PARTITION BY src ORDER BY value DESC, dst))::INTEGER AS rank, dst, value FROM ends)
                                 SELECT src, rank, dst, round(value, 6) AS value FROM ranked WHERE rank <= 10""",
        "graph_neighbours_tfidf": f"""{graph_sql('p.tf * i.idf', '')}, ends AS ({both_ways}),
                                      ranked AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY round(value, 9) DESC) AS rank, value FROM ends)
                                      SELECT src, rank::INTEGER AS rank, round(value, 6) AS value FROM ranked WHERE rank <= 10""",
        "graph_components": f"""{graph_sql('p.tf', '', 'RECURSIVE')}, ends AS ({both_ways}),
                                reached AS (SELECT seq, seq AS label FROM picked
                                            UNION SELECT e.dst, r.label FROM reached r JOIN ends e ON e.src = r.seq WHERE r.label < e.dst)
                                SELECT r.seq, (SELECT count(*) FROM ends e WHERE e.src = r.seq) AS degree, min(label) AS component
                                FROM reached r GROUP BY r.seq""",
        "graph_focus": f"""WITH {LIBRARY} SELECT seq, id FROM (SELECT * FROM active ORDER BY seq LIMIT 50)
                           WHERE id = '7'""",
    }


RAW = r"""
raw AS (
  SELECT t.seq, CASE WHEN l.quality IS NOT NULL THEN t.id END AS own_id, t.title, t.url, t.article_preview,
         t.detected_language || ',' || t.source_file_id AS tags, l.quality, t.source_file_id AS list
  FROM library t LEFT JOIN labels l ON l.doc_id = t.seq)"""

INCOMING = r"""
incoming AS (
  SELECT CAST(page_id AS VARCHAR) AS id, page_id AS in_seq, 'page ' || url AS title, url,
         CAST(NULL AS BOOLEAN) AS is_favorite FROM pages
  UNION ALL
  SELECT 'user' || user_id, event_id + 1000000000, event_type, 'https://users.example/' || user_id,
         CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END FROM events),
newest AS (
  SELECT id, arg_max(title, in_seq) AS title, arg_max(url, in_seq) AS url, min(in_seq) AS first_in,
         arg_max(is_favorite, in_seq) FILTER (WHERE is_favorite IS NOT NULL) AS star FROM incoming GROUP BY id)"""


def mixed_sql(source_id: str) -> str:
    return f"""SELECT {numbered_sql(source_id)} AS id, md5(html) AS title, url,
        'page|' || left(md5(url), 8) AS tags, page_id % 2 = 1 AS is_favorite FROM pages"""


def numbered_sql(source_id: str) -> str:
    """Page ids where page 0 has a number, which counts as no id."""
    return f"""CASE WHEN page_id = 0 THEN {stable_id_sql("url", f"'{source_id}'")} ELSE CAST(page_id AS VARCHAR) END"""


BAD = "SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0"
GOOD = "SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1"


def stable_id_sql(url: str, salt: str) -> str:
    """64-bit FNV-1a of ASCII text, in 128-bit arithmetic."""
    text = f"{salt} || chr(0) || {url}"
    units = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(unicode(substr({text}, i, 1)) AS HUGEINT))"
    step = "(xor(h, u) * 1099511628211) % 18446744073709551616"
    state = f"list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], {units}), lambda h, u: {step})"
    high, low = f"CAST(({state}) // 4294967296 AS BIGINT)", f"CAST(({state}) % 4294967296 AS BIGINT)"
    return f"'gen_' || lpad(lower(to_hex({high})), 8, '0') || lpad(lower(to_hex({low})), 8, '0')"


def harden_sql(text: str) -> str:
    return rf"CASE WHEN regexp_matches({text}, '^[=+\-@\t\r]') THEN '''' || {text} ELSE {text} END"


def round_trip_sql(harden: bool, columns: str) -> str:
    cell = harden_sql if harden else str
    joined = "array_to_string(tags, ',')"
    return f"""WITH {LIBRARY}, placed AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS in_seq FROM active)
      SELECT id, title, url, preview_md5, tags, is_favorite, detected_language, instapaper_url{columns} FROM (
        SELECT id, in_seq, {cell("title")} AS title, url, md5({cell("article_preview")}) AS preview_md5,
               replace({cell(joined)}, ',', '|') AS tags, is_favorite, source_file_id, source_file_name,
               'en' AS detected_language, instapaper_url
        FROM placed WHERE url <> '#')"""


def write_oracles() -> dict[str, str]:
    """Ingest rules, changes to the library, exports and round trips."""
    changed = f"WITH {LIBRARY} SELECT id,"
    normalized = f"""WITH {LIBRARY}, {RAW}
      SELECT coalesce(own_id, gen) AS id, seq, title, url, md5(article_preview) AS preview_md5,
             md5(article_preview) AS content_md5, list AS source_file_id, list || '.csv' AS source_file_name,
             'en' AS detected_language, replace(tags, ',', '|') AS tags,
             'https://www.instapaper.com/read/' || coalesce(own_id, gen) AS instapaper_url, 'instapaper' AS provider,
             quality <> 0 AS is_favorite
      FROM (SELECT r.*, {stable_id_sql("url", "list")} AS gen FROM raw r WHERE url <> '#')"""
    merged = f"""WITH {LIBRARY}, {INCOMING}
      SELECT l.id, l.seq, CASE WHEN n.id IS NULL THEN l.title ELSE n.title END AS title,
             CASE WHEN n.id IS NULL THEN l.url ELSE n.url END AS url,
             CASE WHEN n.id IS NULL THEN l.source_file_id ELSE 'import' END AS source_file_id,
             CASE WHEN n.id IS NULL THEN l.deleted_at END AS deleted_at,
             coalesce(n.star, l.is_favorite, false) AS is_favorite
      FROM library l LEFT JOIN newest n ON n.id = l.id
      UNION ALL
      SELECT n.id, (SELECT max(seq) FROM library) + 1 + n.first_in, n.title, n.url, 'import', NULL,
             coalesce(n.star, false)
      FROM newest n WHERE n.id NOT IN (SELECT id FROM library)"""
    return {
        "stable_id": f"""SELECT CAST(page_id AS VARCHAR) AS id, {stable_id_sql("url", "'pages'")} AS stable_id
                         FROM pages""",
        "normalize_rows": normalized,
        "url_less_counts": f"""WITH {LIBRARY} SELECT source_file_id, count(*) FILTER (WHERE url <> '#') AS imported,
                               count(*) FILTER (WHERE url = '#') AS dropped_no_url FROM library
                               GROUP BY source_file_id""",
        "favorite_flag": "SELECT doc_id, quality <> 0 AS from_number, quality = 1 AS from_text FROM labels",
        "reader_url": """SELECT CAST(page_id AS VARCHAR) AS id, 'https://www.instapaper.com/read/' || page_id AS reader,
                         '' AS "none" FROM pages""",
        "page_domain": f"""SELECT CAST(page_id AS VARCHAR) AS id, {domain_sql("url")} AS domain, 'web' AS shown
                           FROM pages""",
        "safe_url": f"""{changed} CASE WHEN regexp_matches(lower(url), '^https?:') THEN url ELSE '' END AS safe
                        FROM library""",
        "escape_html": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
                          '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages""",
        "harden_cells": f"""{changed} md5({harden_sql("content")}) AS content_md5, '''=' || id AS formula,
                            array_to_string(tags, ',') AS tags FROM library""",
        "node_labels": f"""{changed} left(title, 10) || CASE WHEN length(title) > 10 THEN '...' ELSE '' END AS label
                           FROM library""",
        "deleted_labels": f"""{changed} CASE WHEN deleted_at IS NULL THEN 'unknown' ELSE '2024/1/' || (seq % 28 + 1)
                              || ' 00:00:00' END AS label FROM library""",
        "source_types": f"""{changed} 'csv' AS type, '' AS "none" FROM library""",
        "merge_upsert": merged,
        "displaced_count": f"""WITH {LIBRARY}, {INCOMING} SELECT count(*) AS displaced FROM library
                               WHERE coalesce(deleted_at, '') <> '' AND id IN (SELECT id FROM incoming)""",
        "trash_ids": f"""{changed} CASE WHEN id IN ({BAD}) AND deleted_at IS NULL THEN '2024-06-01T00:00:00.000Z'
                         ELSE deleted_at END AS deleted_at FROM library""",
        "restore_ids": f"{changed} CASE WHEN id NOT IN ({GOOD}) THEN deleted_at END AS deleted_at FROM library",
        "purge_ids": f"{changed} seq FROM library WHERE id NOT IN ({BAD})",
        "empty_trash": f"{changed} seq FROM active",
        "set_favorite": f"{changed} is_favorite OR id IN ({BAD}) AS is_favorite FROM library",
        "toggle_favorite": f"""{changed} CASE WHEN id = '{TARGET}' AND coalesce(deleted_at, '') = ''
                               THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM library""",
        "delete_source": f"{changed} source_file_id FROM library WHERE source_file_id <> 'src3'",
        "replace_source": f"""WITH {LIBRARY}, {INCOMING}, kept AS (SELECT * FROM library WHERE source_file_id <> 'src3')
          SELECT source_file_id, count(*) AS cnt FROM (
            SELECT CASE WHEN n.id IS NULL THEN k.source_file_id ELSE 'import' END AS source_file_id
            FROM kept k LEFT JOIN newest n ON n.id = k.id
            UNION ALL SELECT 'import' FROM newest WHERE id NOT IN (SELECT id FROM kept)) GROUP BY source_file_id""",
        "export_projection": f"""WITH {LIBRARY} SELECT id AS "ID", title AS "Title", md5(article_preview) AS preview,
            CAST(NULL AS VARCHAR) AS "Unknown", array_to_string(tags, ',') AS tags,
            CAST(is_favorite AS INTEGER) AS favorite FROM library""",
        "exported_sources": f"""WITH {LIBRARY}, {SOURCES} SELECT id, name FROM sources
                                WHERE id IN (SELECT source_file_id FROM active)""",
        "unified_csv_rows": f"""{changed} md5({harden_sql("title")}) AS title_md5,
            md5({harden_sql("article_preview")}) AS preview_md5, array_to_string(tags, ',') AS tags, is_favorite
            FROM active""",
        "unified_json_documents": f"""WITH {LIBRARY} SELECT CAST(count(DISTINCT source_file_id) AS INTEGER) AS sources,
            CAST(count(*) AS INTEGER) AS bookmarks, 2 AS version, arg_min(id, seq) AS first_id FROM active GROUP BY seq // 400""",
        "unmapped_columns": f"WITH {SOURCES} SELECT id, 1 AS unmapped FROM sources",
        "csv_round_trip": round_trip_sql(True, ", in_seq, source_file_id, source_file_name"),
        "json_round_trip": round_trip_sql(False, ", source_file_id, source_file_name"),
        "sqlite_round_trip": round_trip_sql(False, ""),
        "sqlite_databases": f"""WITH {LIBRARY} SELECT source_file_id, seq // 1000 AS part, true AS filled FROM active
                                GROUP BY source_file_id, seq // 1000""",
        "save_back_csv": f"""WITH {LIBRARY} SELECT source_file_id, count(*) AS cnt,
            CAST(sum(length({harden_sql("content")})) AS BIGINT) AS content_chars, min(id) AS lowest_id FROM active
            GROUP BY source_file_id""",
        "store_round_trip": f"{changed} seq, title, md5(content) AS content_md5, is_favorite, deleted_at FROM library",
        "import_report": f"""WITH {LIBRARY} SELECT count(*) FILTER (WHERE url <> '#') AS imported,
            CAST(0 AS BIGINT) AS parse_errors, count(*) FILTER (WHERE url = '#') AS dropped_no_url,
            CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS displaced FROM active""",
        "import_mixed_report": f"""WITH {LIBRARY} SELECT count(DISTINCT page_id // 50) + 1 AS files, count(*) FILTER (WHERE page_id % 10 <> 3) AS imported,
            count(*) FILTER (WHERE page_id % 10 = 0) AS parse_errors, count(*) FILTER (WHERE page_id % 10 = 3) AS dropped_no_url,
            CAST(7 AS BIGINT) AS failed, (SELECT count(*) FROM library WHERE coalesce(deleted_at, '') <> ''
                AND seq IN (SELECT page_id FROM pages WHERE page_id % 10 <> 3)) AS displaced, 'zero.csv,zero.json,broken.json' AS failed_names FROM pages""",
        "csv_quoted_split": r"""SELECT CAST(page_id AS VARCHAR) AS id, row_number() OVER (ORDER BY page_id // 1000, page_id) - 1 AS in_seq,
            md5('first' || chr(10) || 'second ' || html) AS title_md5, (SELECT count(*) FROM pages WHERE page_id % 100 = 50) AS parse_errors FROM pages""",
        "json_array_split": """SELECT CAST(page_id AS VARCHAR) AS id, in_seq, md5('"}, {"' || html) AS title_md5,
            (SELECT count(*) FROM pages WHERE page_id % 100 = 50) AS parse_errors
            FROM (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS in_seq FROM pages) WHERE page_id % 100 <> 50""",
        "header_verdicts": "SELECT DISTINCT 'mismatch' AS verdict, 'unified' AS suggested FROM documents",
        "stream_import": f"""SELECT id, title, url, 'file_stream' AS source_file_id, 'https://www.instapaper.com/read/' || id AS instapaper_url
                             FROM (SELECT {numbered_sql("file_stream")} AS id, md5(html) AS title, url FROM pages)""",
        "json_mixed_types": mixed_sql("file_fixed"),
        "stream_mixed": mixed_sql("file_stream"),
        "store_merge": merged,
        "store_changes": f"""{changed} CASE WHEN back THEN 'page ' || page_url ELSE title END AS title,
            CASE WHEN back THEN NULL WHEN id IN ({GOOD}) THEN NULL WHEN id IN ({BAD}) AND deleted_at IS NULL
                 THEN '2024-06-01T00:00:00.000Z' ELSE deleted_at END AS deleted_at,
            NOT back AND (is_favorite OR id IN ({BAD})) AS is_favorite
            FROM (SELECT l.id, l.title, l.deleted_at, l.is_favorite, p.url AS page_url, coalesce(p.page_id % 6 = 0, false) AS back,
                         coalesce(p.page_id % 3 = 0, false) AS purged FROM library l FULL JOIN pages p ON p.page_id = l.seq) WHERE back OR NOT purged""",
        "kept_counts": f"""WITH {LIBRARY}, {INCOMING}, merged AS (
              SELECT l.id, l.seq, CASE WHEN n.id IS NULL THEN l.url ELSE n.url END AS url, CASE WHEN n.id IS NULL THEN l.tags ELSE [] END AS tags,
                     CASE WHEN n.id IS NULL THEN l.source_file_id ELSE 'import' END AS source, CASE WHEN n.id IS NULL THEN l.deleted_at END AS gone
              FROM library l LEFT JOIN newest n ON n.id = l.id
              UNION ALL SELECT id, (SELECT max(seq) FROM library) + 1 + first_in, url, [], 'import', NULL FROM newest WHERE id NOT IN (SELECT id FROM library)),
            rows AS (SELECT *, coalesce(gone, '') = '' AND id NOT IN ({BAD}) AS live FROM merged
                     WHERE id NOT IN (SELECT CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 3 = 0)),
            keys AS (SELECT 'domain' AS kind, {domain_sql('url')} AS key, seq FROM rows WHERE live AND {domain_sql('url')} <> ''
                     UNION ALL SELECT 'folder', source, seq FROM rows WHERE live
                     UNION ALL SELECT 'state', CASE WHEN live THEN 'active' ELSE 'trashed' END, seq FROM rows
                     UNION ALL SELECT 'tag', trim(unnest(tags)), seq FROM rows)
            SELECT kind, key, count(*) AS cnt, min(seq) AS first_seq FROM keys GROUP BY kind, key""",
        "stream_import_counts": """SELECT page_id // 20 AS file,
            count(*) FILTER (WHERE page_id % 10 <> 3 AND page_id // 20 % 5 <> 4) AS imported,
            count(*) FILTER (WHERE page_id % 10 = 3 AND page_id // 20 % 5 <> 4) AS dropped_no_url,
            max(CASE WHEN page_id // 20 % 5 = 4 THEN 1 ELSE 0 END)::BIGINT AS broken FROM pages GROUP BY ALL""",
        "stream_changes": """SELECT 'p' || page_id AS id, md5(html) AS title, url, 'file_stream' AS source_file_id FROM pages
            WHERE page_id % 10 <> 3 AND page_id // 20 % 5 <> 4""",
    }


HAN_TEXTS = f"""han AS (
  SELECT seq, regexp_replace(translate(lower(left(content, 500)), '{LETTERS} ', '{HAN}'), '[^一-龥]', ' ', 'g') AS t FROM texts),
runs AS (SELECT seq, unnest(regexp_extract_all(t, '[一-龥]+')) AS run FROM han),
pairs AS (SELECT seq, substr(run, unnest(range(1, length(run))), 2) AS word FROM runs)"""


def covering_oracles() -> dict[str, str]:
    """The same for operators that no other query runs, or only on its easiest case."""
    changed = f"WITH {LIBRARY} SELECT id,"
    listed = "id IN (SELECT CAST(unnest(range(0, 400, 7)) AS VARCHAR))"
    files = f"""WITH {SOURCES}, own AS (SELECT * FROM sources WHERE id <> 'unused'),
        files AS (SELECT id || '-' || pos AS file, id, pos, name FROM own
                  UNION ALL SELECT id || '-' || (pos + 1000000), id, pos + 1000000, name FROM own WHERE pos % 5 = 0)"""
    return {
        "purge_id_list": f"{changed} seq FROM library WHERE NOT ({listed})",
        "restore_id_list": f"{changed} CASE WHEN NOT ({listed}) THEN deleted_at END AS deleted_at FROM library",
        "profile_coercion": """SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'scraper' WHEN doc_id % 2 = 0 THEN 'unified'
                               ELSE 'scraper' END AS profile FROM documents""",
        "fallback_ids": f"""WITH {LIBRARY}, {RAW} SELECT seq, coalesce(own_id, 'row-' || seq) AS id,
                            'https://www.instapaper.com/read/' || coalesce(own_id, 'row-' || seq) AS instapaper_url FROM raw""",
        "percent": "SELECT doc_id AS seq, CAST(floor((doc_id % 997) / 996.0 * 100 + 0.5) AS BIGINT) AS percent FROM documents",
        "source_ids": f"WITH {SOURCES} SELECT name, 'file_' || sha256(name) AS source_id FROM sources",
        "unique_names": f"""{files}, placed AS (
              SELECT f.*, row_number() OVER (PARTITION BY f.name ORDER BY f.pos) - 1
                     + (SELECT count(*) FROM own o WHERE o.id = f.id AND o.pos % 2 = 0) AS n FROM files f)
            SELECT file, id || '_5' || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.csv' AS name FROM placed""",
        "same_names": f"{files} SELECT file, f.name, o.id AS source_id FROM files f JOIN own o ON o.name = f.name",
        "csv_layouts": f"""WITH {LIBRARY}, {SOURCES}, kinds AS (
              SELECT DISTINCT CASE WHEN pos % 4 = 0 THEN ';' WHEN pos % 4 = 1 THEN chr(9) WHEN pos % 4 = 2 THEN ',' ELSE '|' END AS delimiter,
                     CASE WHEN pos % 4 IN (1, 2) THEN 'crlf' ELSE 'lf' END AS line_end,
                     CASE WHEN pos % 2 = 0 THEN 'id,Title,URL,note,tags' ELSE 'uid,link,id,url,title,content' END AS columns
              FROM sources WHERE id IN (SELECT source_file_id FROM active))
            SELECT *, (SELECT count(*) FROM active WHERE url <> '#') AS imported, CAST(0 AS BIGINT) AS parse_errors FROM kinds""",
        "save_back_json": f"""WITH {LIBRARY}, {SOURCES} SELECT source_file_id, a.id, md5(CASE WHEN pos % 2 = 0 THEN '' ELSE title END) AS title_md5,
            CASE WHEN pos % 2 = 0 THEN array_to_string(tags, ',') END AS tags FROM active a JOIN sources s ON s.id = source_file_id""",
        "import_keep_both": f"""WITH {SOURCES}, own AS (SELECT * FROM sources WHERE id <> 'unused')
            SELECT id, 'https://a.example/' || id AS url, id AS title, (SELECT count(*) FROM own) AS fresh_names FROM own""",
        "delete_source_list": f"WITH {SOURCES} SELECT id, pos, name FROM sources WHERE id <> 'src3'",
        "clear_library": "SELECT count(*) AS cnt FROM documents WHERE false",
        "most_similar_among": f"""{_CORPUS} SELECT t.id, t.seq, round(s.tf, 6) AS score FROM cosines s JOIN library t ON t.seq = s.seq
            WHERE t.id <> '{TARGET}' AND t.is_favorite ORDER BY s.tf DESC, t.seq LIMIT 5""",
        "most_similar_kept": f"""{_CORPUS},
            others AS (SELECT term, tf FROM postings WHERE seq = 11),
            dots AS (SELECT t.seq, coalesce(sum(p.tf * coalesce(o.tf, 0)), 0) AS dot, coalesce(sum(p.tf * p.tf), 0) AS sq
                     FROM texts t LEFT JOIN postings p ON p.seq = t.seq LEFT JOIN others o ON o.term = p.term GROUP BY t.seq),
            eleven AS (SELECT seq, CASE WHEN sq = 0 THEN 0 ELSE dot / (sqrt(sq) * (SELECT sqrt(sum(tf * tf)) FROM others)) END AS score FROM dots)
            SELECT * FROM (SELECT '{TARGET}' AS target, t.id, t.seq, round(s.tf, 6) AS score FROM cosines s JOIN texts t ON t.seq = s.seq WHERE t.id <> '{TARGET}' ORDER BY s.tf DESC, t.seq LIMIT 5)
            UNION ALL SELECT * FROM (SELECT '{TARGET}', t.id, t.seq, round(s.tfidf, 6) FROM cosines s JOIN texts t ON t.seq = s.seq WHERE t.id <> '{TARGET}' ORDER BY s.tfidf DESC, t.seq LIMIT 5)
            UNION ALL SELECT * FROM (SELECT '11', t.id, t.seq, round(s.score, 6) FROM eleven s JOIN texts t ON t.seq = s.seq WHERE t.id <> '11' ORDER BY s.score DESC, t.seq LIMIT 5)""",
        "json_document": round_trip_sql(False, ", in_seq, source_file_id, source_file_name"),
        "han_languages": f"""WITH {LIBRARY}, {HAN_TEXTS} SELECT CASE WHEN length(regexp_replace(t, '[^一-龥]', '', 'g')) > 3 THEN 'zh' ELSE 'en' END AS language,
                             count(*) AS cnt FROM han GROUP BY ALL""",
        "han_words": f"WITH {LIBRARY}, {HAN_TEXTS} SELECT word, count(*) AS cnt FROM pairs GROUP BY word",
        "han_keyword_counts": f"""WITH {LIBRARY}, {HAN_TEXTS} SELECT word, count(*) AS cnt FROM pairs p JOIN han h USING (seq)
            WHERE length(regexp_replace(t, '[^一-龥]', '', 'g')) > 3 AND word NOT IN ({quoted(STOP_ZH)}) GROUP BY word""",
        "sort_title": f"""WITH {LIBRARY} SELECT id, title, row_number() OVER (ORDER BY coalesce(title, '') COLLATE zh_tw, seq) AS rank FROM active""",
    }


def all_oracles() -> dict[str, str]:
    return read_oracles() | write_oracles() | covering_oracles()
