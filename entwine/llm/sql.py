"""SQL for DuckDB that gives the same rows, where SQL can."""

P4_FOUND = """
SELECT 'document' AS item_kind, doc_key AS item_key FROM conll_documents
WHERE length(array_to_string(sentences, ' ')) > 2000
UNION ALL
SELECT 'example', example_id FROM frame_examples WHERE length(masked_input) > 2000
"""

# letters and marks only, by blanks; a run of six words seen earlier covers its words
P9_FOUND = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\s]', '', 'g'), '\s+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 5), ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM words WHERE len(w) > 5)
), again AS (
  SELECT doc_id, i FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY i) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 6) AS t(k) GROUP BY doc_id
)
SELECT c.doc_id FROM covered c JOIN words w USING (doc_id) WHERE c.n >= 0.25 * len(w.w)
"""

# what is wrong in a token, sign by sign; joiners that belong there are taken out first
P2_FOUND = r"""
WITH t AS (
  SELECT token_id, text, regexp_replace(regexp_replace(text, '([\x{94D}\x{9CD}\x{BCD}])[\x{200C}\x{200D}]', '\1', 'g'),
    '([\x{1F000}-\x{1FAFF}])\x{200D}([\x{1F000}-\x{1FAFF}])', '\1\2', 'g') AS rest FROM tokens
), u AS (
  SELECT *, regexp_replace(rest, '([\x{1F000}-\x{1FAFF}])\x{200D}([\x{1F000}-\x{1FAFF}])', '\1\2', 'g') AS bare FROM t
)
SELECT token_id FROM u
WHERE regexp_matches(text, '[\x{FF01}-\x{FFEE}]') OR text <> nfc_normalize(text)
  OR regexp_matches(bare, '[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]')
  OR regexp_matches(text, '^[\s\p{Z}]|[\s\p{Z}]$')
  OR regexp_matches(bare, '\p{Latin}\p{M}*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}]\p{M}*\p{Latin}|\p{Greek}\p{M}*\p{Cyrillic}|\p{Cyrillic}\p{M}*\p{Greek}')
  OR regexp_matches(bare, '\x{905}[\x{93E}\x{94B}\x{94C}]|\x{985}\x{9BE}|[\x{904}-\x{939}\x{93C}\x{93E}-\x{94C}\x{902}\x{985}-\x{9B9}\x{9BC}\x{9BE}-\x{9CC}\x{982}\x{9DC}-\x{9DF}\x{958}-\x{95F}]:')
"""

ORACLES = {"p2_found": P2_FOUND, "p4_found": P4_FOUND, "p9_found": P9_FOUND}
