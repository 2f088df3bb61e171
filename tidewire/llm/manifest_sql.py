"""The SQL twin of the manifest: trees, proofs and folds level by level, in recursive queries."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
# CRC-32 of the decimal digits: bytes are mixed in, then eight shifts each.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _tree(name: str, base: str) -> str:
    """Nodes of all levels of the trees whose leaves ``base`` lists as (tree, number, digest, size)."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, number, digest, size FROM {base}
    UNION ALL
    SELECT tree, level + 1, number // 3, sha256(string_agg(digest, '' ORDER BY number)), (size + 2) // 3
    FROM {name} WHERE size > 1 GROUP BY tree, level, number // 3, size
)"""


def _path(name: str, base: str, nodes: str) -> str:
    """Proof and fold of each row ``base`` lists as (r, tree, number, size, proof, folded), up to its tree's root."""
    return f"""{name} AS (
    SELECT r, tree, 0 AS level, number, size, proof, folded FROM {base}
    UNION ALL
    SELECT p.r, p.tree, p.level + 1, p.number // 3, (p.size + 2) // 3,
           p.proof || coalesce(string_agg(n.digest, '' ORDER BY n.number) FILTER (WHERE n.number <> p.number), ''),
           sha256(string_agg(CASE WHEN n.number = p.number THEN p.folded ELSE n.digest END, '' ORDER BY n.number))
    FROM {name} p JOIN {nodes} n ON n.tree = p.tree AND n.level = p.level AND n.number // 3 = p.number // 3
    WHERE p.size > 1 GROUP BY p.r, p.tree, p.level, p.number, p.size, p.proof, p.folded
)"""


OP12_SQL = f"""
WITH RECURSIVE marked AS (
    SELECT row_number() OVER () AS r, doc_id, source, text, {_HEAD} AS head, coalesce(({_CRC}) % 2 = 0, false) AS altered FROM documents
), leaves AS (
    SELECT r, doc_id, source, sha256(head || {_field("text")}) AS leaf,
           sha256(head || {_field("CASE WHEN altered THEN replace(text, chr(10), '') ELSE text END")}) AS claim
    FROM marked
), placed AS (
    SELECT r, doc_id, leaf, claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS number,
           count(*) OVER (PARTITION BY source) AS size
    FROM leaves
), base AS (
    SELECT tree, number, leaf AS digest, size FROM placed
), {_tree("nodes", "base")}, subroots AS (
    SELECT 0 AS tree, tree AS number, digest, (SELECT count(*) FROM nodes WHERE size = 1) AS size FROM nodes WHERE size = 1
), {_tree("top", "subroots")}, begun AS (
    SELECT r, tree, number, size, '' AS proof, claim AS folded FROM placed
), {_path("inner_path", "begun", "nodes")}, risen AS (
    SELECT i.r, 0 AS tree, i.tree AS number, s.size, i.proof, i.folded
    FROM inner_path i JOIN subroots s ON s.number = i.tree WHERE i.size = 1
), {_path("top_path", "risen", "top")}
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
       e.folded = t.digest AS verified
FROM placed p JOIN subroots s ON s.number = p.tree JOIN top t ON t.size = 1 JOIN top_path e ON e.r = p.r AND e.size = 1
"""
