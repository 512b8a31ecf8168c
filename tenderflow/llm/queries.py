"""The registered corpus queries and the SQL that checks them where SQL can."""

from __future__ import annotations

from tenderflow.llm.adaptive_quality import op10_adaptive_quality
from tenderflow.llm.flat_graph import op11_flat_graph
from tenderflow.llm.label_sharding import op5_label_propagation
from tenderflow.llm.merkle_manifest import op13_merkle_manifest
from tenderflow.llm.oracles import ORACLES as BUILT_ORACLES
from tenderflow.llm.ownership_secrets import op7_ownership_secrets
from tenderflow.llm.poisson_mixing import op1_poisson_mix
from tenderflow.llm.posting_lists import op3_posting_lists
from tenderflow.llm.prefix_join import op8_grouped_prefix_join
from tenderflow.llm.prefix_trie import op12_prefix_trie
from tenderflow.llm.string_kernel_language import op4_string_kernel_language
from tenderflow.llm.template_text import op2_template_text
from tenderflow.llm.tier_packing import op6_tier_packing
from tenderflow.llm.token_columns import op9_token_columns

QUERIES = {
    "op1_poisson_mix": op1_poisson_mix,
    "op2_template_text": op2_template_text,
    "op3_posting_lists": op3_posting_lists,
    "op4_string_kernel_language": op4_string_kernel_language,
    "op5_label_propagation": op5_label_propagation,
    "op6_tier_packing": op6_tier_packing,
    "op7_ownership_secrets": op7_ownership_secrets,
    "op8_grouped_prefix_join": op8_grouped_prefix_join,
    "op9_token_columns": op9_token_columns,
    "op10_adaptive_quality": op10_adaptive_quality,
    "op11_flat_graph": op11_flat_graph,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The others follow from hashes, sketches, tokenizers, markup or a trained model, which SQL cannot express; tests hold them against brute force.
ORACLES: dict[str, str] = {
    **BUILT_ORACLES,
    "op8_grouped_prefix_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
        FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
}
