"""DuckDB SQL of the operators whose whole result SQL can express, built from parts where levels repeat."""

from __future__ import annotations

#: Unsigned CRC-32 of a decimal number, from the reversed polynomial 0xEDB88320.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(number: str) -> str:
    """Reads the column t of the one-row table crc."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


def _framed(c: str) -> str:
    s = f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({s}) || ':' || {s} END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _levels(name: str, count: int) -> list[str]:
    """{name}0 (tree, pos, dg, c) is given; each level hashes runs of 16 while there are several nodes, and {name}s has the siblings."""
    out = []
    for k in range(1, count + 1):
        below = f"{name}{k - 1}"
        run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}s{k} AS (SELECT tree, pos, c, coalesce(string_agg(dg, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(dg, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {below})""")
        out.append(f"""{name}{k} AS (SELECT tree, pos // 16 AS pos, CASE WHEN max(c) > 1 THEN sha256(string_agg(dg, '' ORDER BY pos)) ELSE any_value(dg) END AS dg,
            (max(c) + 15) // 16 AS c FROM {below} GROUP BY tree, pos // 16)""")
    return out


def _path(name: str, count: int, start: str, extra: str) -> list[str]:
    """Proof and fold of the rows {start}(tree, pos, f, p, ...) from level to level."""
    out = []
    for k in range(1, count + 1):
        source = start if k == 1 else f"{name}f{k - 1}"
        out.append(f"""{name}f{k} AS (SELECT x.tree, x.pos // 16 AS pos, {extra}, x.p || s.l || s.r AS p,
            CASE WHEN s.c > 1 THEN sha256(s.l || x.f || s.r) ELSE x.f END AS f FROM {source} x JOIN {name}s{k} s ON s.tree = x.tree AND s.pos = x.pos)""")
    return out


def merkle(levels: int = 5, source_levels: int = 3) -> str:
    """Up to 16 ** levels rows of a source and 16 ** source_levels sources."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        CRC_TABLE,
        f"""src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))""",
        f"""rows0 AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {crc32('doc_id')} % 5 = 0 THEN {_leaf(lower)} ELSE {_leaf('text')} END AS changed FROM documents, crc)""",
        """base AS (SELECT d.*, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s.tree) AS c
            FROM rows0 d JOIN src s ON s.source IS NOT DISTINCT FROM d.source)""",
        "a0 AS (SELECT tree, pos, leaf AS dg, c FROM base)",
        *_levels("a", levels),
        f"b0 AS (SELECT 0 AS tree, tree AS pos, dg, (SELECT count(*) FROM src) AS c FROM a{levels})",
        *_levels("b", source_levels),
        "start AS (SELECT tree, pos, doc_id, leaf, tree AS own, changed AS f, '' AS p FROM base)",
        *_path("a", levels, "start", "x.doc_id, x.leaf, x.own"),
        f"up AS (SELECT 0 AS tree, own AS pos, doc_id, leaf, own, f, p FROM af{levels})",
        *_path("b", source_levels, "up", "x.doc_id, x.leaf, x.own"),
    ]
    return f"""WITH {', '.join(parts)} SELECT doc_id, leaf, t.dg AS subroot, r.dg AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.dg AS verified
        FROM bf{source_levels} x JOIN a{levels} t ON t.tree = x.own CROSS JOIN b{source_levels} r"""


def trie() -> str:
    framed = "strlen(role) || ':' || role || strlen(text) || ':' || text"
    return f"""WITH {CRC_TABLE},
        t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
            md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, c - c % 100 AS b, {crc32('c')} % 6 AS h FROM (SELECT DISTINCT c FROM t), crc),
        r AS (SELECT v.c, 0 AS own, t.i, t.role, t.text FROM convs v JOIN t ON t.c = v.b AND t.i <= v.h
            UNION ALL SELECT v.c, 1, t.i, t.role, t.text FROM convs v JOIN t ON t.c = v.c AND t.i > v.h),
        p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, {framed} AS s, length(text) AS len FROM r),
        pre AS (SELECT c, d, len, string_agg(s, '') OVER (PARTITION BY c ORDER BY d) AS k FROM p UNION ALL SELECT c, 0, 0, '' FROM convs),
        ends AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
        node AS (SELECT k, x.d, min(x.c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
            sha256(coalesce(string_agg(CAST(e.c AS VARCHAR), ',' ORDER BY e.c), '')) AS ends_sha256 FROM pre x LEFT JOIN ends e ON e.c = x.c AND e.d = x.d GROUP BY k, x.d),
        tied AS (SELECT v.k, v.d, u.k AS up_k, u.d AS up_d FROM node v JOIN pre u ON u.c = v.conv_id AND u.d = v.d - 1),
        kids AS (SELECT up_k AS k, up_d AS d, count(*) AS n FROM tied GROUP BY ALL),
        sums AS (SELECT u.k, u.d, sum((v.n_convs - 1) * v.len) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
            FROM node v LEFT JOIN kids ON kids.k = v.k AND kids.d = v.d JOIN pre u ON u.c = v.conv_id AND u.d <= v.d GROUP BY u.k, u.d)
        SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
            CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM node v JOIN sums s ON s.k = v.k AND s.d = v.d LEFT JOIN kids ON kids.k = v.k AND kids.d = v.d
            LEFT JOIN tied ON tied.k = v.k AND tied.d = v.d LEFT JOIN node up ON up.k = tied.up_k AND up.d = tied.up_d"""


def flat_graph() -> str:
    return """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT m.vec_id, coalesce(n.n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""


ORACLES = {"op11_flat_graph": flat_graph(), "op12_prefix_trie": trie(), "op13_merkle_manifest": merkle()}
