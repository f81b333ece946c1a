"""SQL that says the same as those queries that SQL can express, for DuckDB."""

from __future__ import annotations

from tessella.llm.quality_rules import ALPHA, DELTA, MAX_REPEATED_PERCENT, MIN_WORDS, RULES

TOP_K = """
    WITH sound AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cells AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sound),
    scores AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
        FROM cells q JOIN cells c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

JACCARD = f"""
    WITH RECURSIVE words AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
    listed AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM words),
    shingles AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM listed),
    sizes AS (SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    alike AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    either AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
    reach AS (SELECT doc_id AS node, doc_id AS root FROM words UNION SELECT either.b, reach.root FROM reach JOIN either ON either.a = reach.node)
    SELECT sizes.doc_id, CAST(n AS BIGINT) AS n_shingles, min(root) AS component_id FROM sizes JOIN reach ON reach.node = sizes.doc_id GROUP BY sizes.doc_id, n"""

_TESTS = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {i} AS step, CAST({c} AS DOUBLE) AS cutoff, {r} > {c} AS out FROM labelled" for r, steps in RULES.items() for i, c in enumerate(steps))
_CUTS = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS cut_{r}" for r in RULES)
_OVER = " OR ".join(f"coalesce({r} > cut_{r}, false)" for r in RULES)

QUALITY = rf"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {WORDS} AS w, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS solid, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
    twice AS (SELECT doc_id, unnest(range(i, i + 5)) AS spot FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
    repeats AS (SELECT doc_id, count(DISTINCT spot) AS r FROM twice GROUP BY doc_id),
    counts AS (SELECT doc_id, stratum, len(w) AS n_words, length(solid) AS word_chars, length(solid) - length(regexp_replace(solid, '[#*$%&|<>]+', '', 'g')) AS n_symbols, length(solid) - length(regexp_replace(solid, '\p{{Lu}}+', '', 'g')) AS upper, length(solid) - length(regexp_replace(solid, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS other, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM texts LEFT JOIN repeats USING (doc_id)),
    measured AS (SELECT *, coalesce(CAST(n_symbols AS DOUBLE) / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(CAST(upper AS DOUBLE) / nullif(word_chars, 0), 0) AS upper_share, coalesce(CAST(other AS DOUBLE) / nullif(word_chars, 0), 0) AS punctuation_share, coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(CAST(word_chars AS DOUBLE) / nullif(n_words, 0), 0) AS mean_word_length FROM counts),
    labelled AS (SELECT measured.*, quality = 1 AS good FROM measured JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)),
    tested AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND out) AS k, count(*) FILTER (WHERE NOT good) AS bad, count(*) FILTER (WHERE NOT good AND out) AS caught FROM ({_TESTS}) GROUP BY ALL),
    gains AS (SELECT *, caught / nullif(CAST(bad AS DOUBLE), 0) - k / nullif(CAST(n AS DOUBLE), 0) AS gain, n > 0 AND k < n * {ALPHA} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM labelled)) AS certified FROM tested),
    chosen AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) AS place FROM gains WHERE certified AND gain > 0) WHERE place = 1),
    cuts AS (SELECT stratum, {_CUTS} FROM chosen GROUP BY stratum),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM measured LEFT JOIN cuts USING (stratum))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT ({_OVER}) AS kept FROM judged"""



def crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters, bit by bit; null of null."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, s: xor(xor(c, s) >> 1, 3988292384 * (xor(c, s) & 1))), 4294967295) END"


TRIE = f"""
    WITH turns AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
            sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS turn_hash, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turns WHERE i = 1),
    rebuilt AS (
        SELECT c.conv_id, t.i, t.turn_hash, t.n FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= c.h
        UNION ALL SELECT c.conv_id, t.i, t.turn_hash, t.n FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
    prefixes AS (
        SELECT conv_id, row_number() OVER w AS depth, string_agg(turn_hash, ',') OVER w AS path, n FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    members AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes),
    nodes AS (
        SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved, CASE WHEN depth > 0 THEN left(path, greatest(0, 65 * (depth - 1) - 1)) END AS up,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY depth, path),
    families AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    leafed AS (SELECT nodes.*, coalesce(families.n, 0) AS n_children FROM nodes LEFT JOIN families USING (depth, path)),
    spread AS (SELECT depth, path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM leafed),
    sums AS (SELECT d AS depth, left(path, greatest(0, 65 * d - 1)) AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM spread GROUP BY ALL)
    SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
    FROM leafed x JOIN sums USING (depth, path) LEFT JOIN nodes p ON p.depth = x.depth - 1 AND p.path = x.up"""


def _leaf(text: str) -> str:
    fields = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({fields})"


def _tree(of: str) -> str:
    """Rows of a recursive table: level, grp, idx, n and digest, from level 0 in `of`."""
    up = "SELECT level + 1, grp, idx // 8 AS idx, (n + 7) // 8 AS n, sha256(string_agg(digest, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY level, grp, idx // 8, n"
    return f"SELECT 0 AS level, grp, idx, n, digest FROM {of} UNION ALL {up}"


MERKLE = f"""
    WITH RECURSIVE hashed AS (
        SELECT doc_id, coalesce('.' || lang, '') AS grp, {_leaf("text")} AS digest,
            CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS tried FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest, tried) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
    tree AS ({_tree("leaves").format("tree")}),
    subroots AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, digest, grp AS lang FROM tree WHERE n = 1),
    top AS ({_tree("subroots").format("top")}),
    runs AS (
        SELECT 0 AS part, level, grp, idx // 8 AS run, list(digest ORDER BY idx) AS nodes FROM tree WHERE n > 1 GROUP BY ALL
        UNION ALL SELECT 1, level, grp, idx // 8 AS run, list(digest ORDER BY idx) FROM top WHERE n > 1 GROUP BY ALL),
    own AS (SELECT part, level, leaves.*, CAST(leaves.idx // CAST(power(8, level) AS BIGINT) % 8 AS BIGINT) AS place, nodes FROM leaves JOIN runs ON part = 0 AND runs.grp = leaves.grp AND run = leaves.idx // CAST(power(8, level + 1) AS BIGINT)),
    shared AS (SELECT part, level, leaves.*, CAST(subroots.idx // CAST(power(8, level) AS BIGINT) % 8 AS BIGINT) AS place, nodes FROM leaves JOIN subroots ON subroots.lang = leaves.grp JOIN runs ON part = 1 AND run = subroots.idx // CAST(power(8, level + 1) AS BIGINT)),
    steps AS (SELECT *, array_to_string(nodes[:place], '') AS before, array_to_string(nodes[place + 2:], '') AS after FROM (SELECT * FROM own UNION ALL SELECT * FROM shared)),
    proven AS (SELECT grp, idx, sha256(string_agg(before || after, '' ORDER BY part, level)) AS proof, list(before || '|' || after ORDER BY part, level) AS path FROM steps GROUP BY ALL),
    folded AS (SELECT leaves.*, coalesce(proof, sha256('')) AS proof_sha256, list_reduce(list_prepend(tried, coalesce(path, [])), lambda a, s: sha256(replace(s, '|', a))) AS folded_root FROM leaves LEFT JOIN proven USING (grp, idx))
    SELECT doc_id, folded.digest AS leaf, subroots.digest AS subroot, top.digest AS root, proof_sha256, folded_root, folded_root = top.digest AS verified
    FROM folded JOIN subroots ON subroots.lang = folded.grp CROSS JOIN (SELECT digest FROM top WHERE n = 1) AS top"""


ARCHIVES = """
    WITH known AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place, first(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS last FROM known),
    typed AS (SELECT *, place > 1 AND strlen(payload) >= 1000 AS again FROM ranked)
    SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM typed"""

SQL: dict[str, str] = {"op4_quality_rules": QUALITY, "op8_ngram_jaccard_join": JACCARD, "op10_exact_top_k": TOP_K, "op11_conversation_trie": TRIE, "op12_merkle_manifest": MERKLE, "op13_warc": ARCHIVES}
