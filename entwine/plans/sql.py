"""SQL of the corpus views for DuckDB, as common table expressions that queries put together."""

from __future__ import annotations

MARK = r"\(\p{Nd}+\)|\(\p{Nd}+|\p{Nd}+\)"
_DIGITS = "translate({}, '०१२३४५६७८९০১২৩৪৫৬৭৮৯௦௧௨௩௪௫௬௭௮௯', '012345678901234567890123456789')"

#: name -> (what it needs, its text); recursive ones are marked.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "tok": ((), """
  SELECT doc_key, sent_idx, tok_pos, idx, coalesce(text, '') AS text, coalesce(coref, '-') AS coref FROM tokens
  WHERE doc_key IS NOT NULL AND sent_idx IS NOT NULL AND tok_pos IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_key, sent_idx, tok_pos ORDER BY loaded_at NULLS LAST, token_id NULLS LAST) = 1"""),
    "doc": ((), """
  SELECT d.doc_key, d.doc_id, d.corpus, d.split, coalesce(c.lang, 'und') AS lang
  FROM conll_documents d LEFT JOIN language_codes c ON lower(trim(d.language)) = lower(c.code)"""),
    "sent": (("tok",), """
  SELECT doc_key, sent_idx, list(text ORDER BY tok_pos) AS words, CAST(count(*) AS INTEGER) AS n_tokens FROM tok GROUP BY ALL"""),
    "strict": (("tok",), rf"""
  SELECT doc_key, sent_idx, tok_pos, CAST(i - 1 AS INTEGER) AS part_pos, regexp_replace(p[i], '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS part
  FROM (SELECT *, string_split(coref, '|') AS p FROM tok WHERE regexp_matches(coref, '[()]')), unnest(range(1, len(p) + 1)) AS t(i)"""),
    "loose": (("tok",), rf"""
  SELECT doc_key, sent_idx, tok_pos, CAST(i - 1 AS INTEGER) AS part_pos, p[i] AS part
  FROM (SELECT *, regexp_extract_all(coref, '{MARK}') AS p FROM tok), unnest(range(1, len(p) + 1)) AS t(i)"""),
    "men": (("ev",), """
  SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY lft, e_sent, e_tok, e_part, cluster_id) - 1 AS INTEGER) AS mention_ord,
    sent_idx, start_tok, e_sent AS end_sent, e_tok AS end_tok, cluster_id, false AS is_zero
  FROM (
    SELECT doc_key, cluster_id, e_sent IS NULL AS lft, sent_idx, tok_pos AS start_tok,
      coalesce(e_sent, sent_idx) AS e_sent, coalesce(e_tok, tok_pos) AS e_tok, coalesce(e_part, part_pos) AS e_part
    FROM (
      SELECT *, CASE WHEN lead(kind) OVER w = 'close' THEN lead(sent_idx) OVER w END AS e_sent,
        CASE WHEN lead(kind) OVER w = 'close' THEN lead(tok_pos) OVER w END AS e_tok,
        CASE WHEN lead(kind) OVER w = 'close' THEN lead(part_pos) OVER w END AS e_part
      FROM (
        SELECT *, lag(kind) OVER (PARTITION BY doc_key, cluster_id ORDER BY sent_idx, tok_pos, part_pos) AS prior FROM ev WHERE kind <> 'singleton'
      ) WHERE CASE WHEN kind = 'open' THEN prior IS NULL OR prior = 'close' ELSE prior = 'open' END
      WINDOW w AS (PARTITION BY doc_key, cluster_id ORDER BY sent_idx, tok_pos, part_pos)
    ) WHERE kind = 'open'
    UNION ALL
    SELECT doc_key, cluster_id, false, sent_idx, tok_pos, sent_idx, tok_pos, part_pos FROM ev WHERE kind = 'singleton'
  )"""),
    "sound": (("men",), """
  SELECT doc_key, mention_ord, sent_idx, start_tok, end_tok, cluster_id, is_zero FROM men WHERE sent_idx = end_sent AND end_tok >= start_tok"""),
    "keyed": (("sound",), """
  SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY doc_key, sent_idx, start_tok, end_tok ORDER BY mention_ord) = 1"""),
    "headed": (("keyed", "sent"), """
  SELECT k.*, lower(coalesce(h[len(h)], words[least(end_tok + 1, n_tokens)])) AS head
  FROM (SELECT k.*, s.words, s.n_tokens, list_filter(s.words[k.start_tok + 1 : k.end_tok + 1], lambda w: instr('.,;:!?।॥', w) = 0 AND w <> '') AS h
        FROM keyed k JOIN sent s USING (doc_key, sent_idx)) k"""),
    "budgeted": (("sent",), """
  SELECT s.*, row_number() OVER (PARTITION BY doc_key ORDER BY sent_idx) AS i, count(*) OVER (PARTITION BY doc_key) AS n_sent,
    CASE WHEN count(*) OVER (PARTITION BY doc_key) < 2 THEN {budget}
      ELSE coalesce((SELECT max(b) FROM (VALUES {series}) AS v(b) WHERE b < t.total), 1) END AS budget
  FROM sent s JOIN (SELECT doc_key, sum(n_tokens) AS total FROM sent GROUP BY ALL) t USING (doc_key)"""),
    "packed*": (("budgeted",), """
  SELECT doc_key, sent_idx, i, n_tokens, budget, 0 AS frame_idx, n_tokens AS used FROM budgeted WHERE i = 1
  UNION ALL
  SELECT b.doc_key, b.sent_idx, b.i, b.n_tokens, b.budget,
    CASE WHEN p.used > 0 AND p.used + b.n_tokens > b.budget THEN p.frame_idx + 1 ELSE p.frame_idx END,
    CASE WHEN p.used > 0 AND p.used + b.n_tokens > b.budget THEN b.n_tokens ELSE p.used + b.n_tokens END
  FROM packed p JOIN budgeted b ON b.doc_key = p.doc_key AND b.i = p.i + 1"""),
    "ordered": (("sound", "sent"), """
  SELECT m.*, s.n_tokens, row_number() OVER (PARTITION BY m.doc_key, m.sent_idx ORDER BY start_tok, start_tok - end_tok, mention_ord) AS r
  FROM sound m JOIN sent s USING (doc_key, sent_idx)"""),
    "walk*": (("ordered",), """
  SELECT doc_key, sent_idx, r, start_tok < n_tokens AS taken, CASE WHEN start_tok < n_tokens THEN end_tok + 1 ELSE 0 END AS free FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.doc_key, o.sent_idx, o.r, o.start_tok >= w.free AND o.start_tok < o.n_tokens,
    CASE WHEN o.start_tok >= w.free AND o.start_tok < o.n_tokens THEN o.end_tok + 1 ELSE w.free END
  FROM walk w JOIN ordered o ON o.doc_key = w.doc_key AND o.sent_idx = w.sent_idx AND o.r = w.r + 1"""),
    "taken": (("walk", "ordered"), """
  SELECT o.* FROM ordered o JOIN walk w USING (doc_key, sent_idx, r) WHERE w.taken"""),
    # a row for each sentence of each pair; side 0 is the before frame
    "paired": (("packed",), """
  SELECT p.doc_key, p.frame_idx - side AS pair_idx, side, p.sent_idx FROM packed p, (VALUES (0), (1)) AS v(side)
  WHERE p.frame_idx - side >= 0 AND p.frame_idx - side < (SELECT max(q.frame_idx) FROM packed q WHERE q.doc_key = p.doc_key)"""),
    "pair_mentions": (("paired", "taken"), """
  SELECT doc_key, pair_idx, side, sent_idx, start_tok, end_tok, cluster_id, is_zero, nth,
    CAST(dense_rank() OVER (PARTITION BY doc_key, pair_idx ORDER BY first) - 1 AS INTEGER) AS local_no
  FROM (SELECT *, min(nth) OVER (PARTITION BY doc_key, pair_idx, cluster_id) AS first
        FROM (SELECT p.*, t.start_tok, t.end_tok, t.cluster_id, t.is_zero,
                row_number() OVER (PARTITION BY p.doc_key, p.pair_idx ORDER BY side, p.sent_idx, t.r) AS nth
              FROM paired p JOIN taken t USING (doc_key, sent_idx)))"""),
    # every word or mention of a pair's sentence is an item at its place
    "items": (("pair_mentions", "paired", "sent"), """
  SELECT p.doc_key, p.pair_idx, p.side, p.sent_idx, i - 1 AS place, s.words[i] AS masked, s.words[i] AS output
  FROM paired p JOIN sent s USING (doc_key, sent_idx), unnest(range(1, s.n_tokens + 1)) AS t(i)
  WHERE NOT EXISTS (SELECT 1 FROM taken m WHERE m.doc_key = p.doc_key AND m.sent_idx = p.sent_idx AND i - 1 BETWEEN m.start_tok AND m.end_tok)
  UNION ALL
  SELECT m.doc_key, m.pair_idx, m.side, m.sent_idx, m.start_tok, '<m>' || array_to_string(s.words[m.start_tok + 1 : m.end_tok + 1], ' ') || '</m>#MASK',
    '<m>' || array_to_string(s.words[m.start_tok + 1 : m.end_tok + 1], ' ') || '</m>#' || m.local_no
  FROM pair_mentions m JOIN sent s USING (doc_key, sent_idx)"""),
    "pair_text": (("items",), """
  SELECT doc_key, pair_idx, string_agg(masked, ' [MID] ' ORDER BY side) AS masked_input, string_agg(output, ' [MID] ' ORDER BY side) AS output
  FROM (SELECT doc_key, pair_idx, side, string_agg(masked, ' ' ORDER BY sent_idx, place) AS masked, string_agg(output, ' ' ORDER BY sent_idx, place) AS output FROM items GROUP BY ALL)
  GROUP BY ALL"""),
    # merging: a node is a local number of a pair; it continues the node of its first before mention
    "numbered": (("pair_mentions",), """
  SELECT *, {number} AS n FROM pair_mentions"""),
    "pair_heads": (("pair_mentions", "sent"), """
  SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_key, pair_idx ORDER BY first) - 1 AS INTEGER) AS head_no
  FROM (SELECT *, min(nth) OVER (PARTITION BY doc_key, pair_idx, lower(coalesce(h[len(h)], last))) AS first
        FROM (SELECT m.*, list_filter(s.words[m.start_tok + 1 : m.end_tok + 1], lambda w: instr('.,;:!?।॥', w) = 0 AND w <> '') AS h, s.words[least(m.end_tok + 1, s.n_tokens)] AS last
              FROM pair_mentions m JOIN sent s USING (doc_key, sent_idx)))"""),
    "numbered_heads": (("pair_heads",), """
  SELECT *, head_no AS n FROM pair_heads"""),
    "link": (("numbered",), """
  SELECT b.doc_key, b.pair_idx, b.n, arg_min(a.n, b.nth) AS parent FROM numbered b
  JOIN numbered a ON a.doc_key = b.doc_key AND a.pair_idx = b.pair_idx - 1 AND a.side = 1 AND a.sent_idx = b.sent_idx AND a.start_tok = b.start_tok AND a.end_tok = b.end_tok
  WHERE b.side = 0 GROUP BY ALL"""),
    "node": (("numbered", "link"), """
  SELECT n.doc_key, n.pair_idx, n.n, min(n.nth) AS nth, any_value(l.parent) AS parent FROM numbered n LEFT JOIN link l USING (doc_key, pair_idx, n) GROUP BY ALL"""),
    "tree*": (("node",), """
  SELECT doc_key, pair_idx, n, row_number() OVER (PARTITION BY doc_key ORDER BY pair_idx, nth) - 1 AS cluster_id FROM node WHERE parent IS NULL
  UNION ALL
  SELECT c.doc_key, c.pair_idx, c.n, t.cluster_id FROM tree t JOIN node c ON c.doc_key = t.doc_key AND c.pair_idx = t.pair_idx + 1 AND c.parent = t.n"""),
    "merged": (("tree", "numbered"), """
  SELECT m.doc_key, m.sent_idx, m.start_tok, m.end_tok, t.cluster_id FROM numbered m JOIN tree t USING (doc_key, pair_idx, n) WHERE side = 1 OR pair_idx = 0"""),
    # scoring of gold against one of the baselines
    "scored": (("headed",), """
  SELECT h.*, {pred} AS pred_id FROM headed h
  WHERE doc_key IN (SELECT doc_key FROM headed GROUP BY ALL HAVING count(*) >= 2)"""),
    "cell": (("scored",), """
  SELECT *, sum(n) OVER (PARTITION BY doc_key, gold_id) AS gold_size, sum(n) OVER (PARTITION BY doc_key, pred_id) AS pred_size
  FROM (SELECT doc_key, cluster_id AS gold_id, pred_id, count(*) AS n FROM scored GROUP BY ALL)"""),
    "golds": (("cell",), "\n  SELECT doc_key, gold_id, any_value(gold_size) AS size, count(*) AS parts, max(2 * n / (gold_size + pred_size)) AS best FROM cell GROUP BY ALL"),
    "preds": (("cell",), "\n  SELECT doc_key, pred_id, any_value(pred_size) AS size, count(*) AS parts, max(2 * n / (gold_size + pred_size)) AS best FROM cell GROUP BY ALL"),
}

PREDICTIONS = {
    "all_singletons": "CAST(mention_ord AS BIGINT)",
    "all_one_cluster": "CAST(0 AS BIGINT)",
    "head_match": "head",
    "gold": "cluster_id",
}


def events(strict: bool) -> tuple[tuple[str, ...], str]:
    source = "strict" if strict else "loose"
    number = _DIGITS.format("regexp_replace(part, '[()]', '', 'g')")
    return (source,), rf"""
  SELECT doc_key, sent_idx, tok_pos, part_pos,
    CASE WHEN part LIKE '(%)' THEN 'singleton' WHEN part LIKE '(%' THEN 'open' ELSE 'close' END AS kind, try_cast({number} AS BIGINT) AS cluster_id
  FROM {source} WHERE regexp_full_match(part, '{MARK}')"""


def select(final: str, *needs: str, strict: bool = False, budget: int = 256, pred: str = "all_one_cluster", number: str = "local_no", heads: bool = False) -> str:
    """A statement: the parts that are needed, in order, and the final select; heads: pairs are numbered by head words."""
    parts = PARTS | {"ev": events(strict)}
    if heads:
        parts |= {"numbered": parts["numbered_heads"]}
    done: dict[str, str] = {}

    def add(name: str) -> None:
        key = name if name in parts else name + "*"
        if name in done:
            return
        wants, text = parts[key]
        for w in wants:
            add(w)
        series = ", ".join(f"({b})" for b in _series(budget))
        for k, v in (("{budget}", str(budget)), ("{series}", series), ("{pred}", PREDICTIONS[pred]), ("{number}", number)):
            text = text.replace(k, v)
        done[name] = text

    for name in needs:
        add(name)
    body = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH RECURSIVE {body}\n{final}" if body else final


def _series(budget: int) -> list[int]:
    out = [budget]
    while out[-1] > 1:
        out.append(out[-1] // 2)
    return out
