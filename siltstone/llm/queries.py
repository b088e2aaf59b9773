"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op9_nearest
from .bpe import op11_bpe_round_trip
from .collocations import OP13_SQL, op13_collocations
from .conversations import OP12_SQL, op12_conversation_repair
from .decontaminate import op10_decontamination
from .packing import op7_best_fit_packing
from .pii import op5_personal_data
from .quality import op4_quality
from .rindex import op3_repeated_strings
from .simhash import op2_simhash_components
from .substrings import op1_substring_dedup
from .tokens import op8_token_files
from .toxicity import op6_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_components": op2_simhash_components,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_quality": op4_quality,
    "op5_personal_data": op5_personal_data,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op9_nearest": op9_nearest,
    "op10_decontamination": op10_decontamination,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op12_conversation_repair": OP12_SQL,
    "op13_collocations": OP13_SQL,
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(w, i, i + 12), ' ')) AS first FROM n),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM s WHERE first < doc_id) x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""",
}
