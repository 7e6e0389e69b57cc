"""SQL of the scans whose state a window can't carry: a recursive query walks every scope by place,
with the state in columns. Used beside the Spark queries to compare results."""

from __future__ import annotations

from parley.plans.archive import M

#: Termed messages by place in their chat.
TERMED = f"""{M}, t AS (SELECT chat_id, us, row_id, ['t' || (k // 10), 'u' || (k % 10), substr(kind, 1, 1)] AS terms, CASE WHEN kind = 'purchase' THEN k % 3 END AS object,
 row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m)"""


def cooldown(rows: str, cooldown_us: int, result: str) -> str:
    """``rows`` defines t (chat_id, us, row_id, wants, pos); ``result`` reads s with ``decision``."""
    first = "CASE WHEN wants THEN 'reply' ELSE 'no_match' END"
    free = f"t.wants AND (s.last IS NULL OR t.us - s.last >= {cooldown_us})"
    return f"""WITH RECURSIVE {rows},
s AS (SELECT chat_id, us, row_id, pos, {first} AS decision, CASE WHEN wants THEN us END AS last FROM t WHERE pos = 1
 UNION ALL SELECT t.chat_id, t.us, t.row_id, t.pos, CASE WHEN {free} THEN 'reply' WHEN t.wants THEN 'cooldown' ELSE 'no_match' END, CASE WHEN {free} THEN t.us ELSE s.last END
 FROM s JOIN t ON t.chat_id = s.chat_id AND t.pos = s.pos + 1) {result}"""


def blocks(gap_us: int) -> str:
    new = f"(t.us - s.us > {gap_us} OR NOT list_has_any(flatten(s.recent), t.terms))"
    return f"""WITH RECURSIVE {TERMED},
s AS (SELECT chat_id, us, row_id, pos, 0 AS block, [terms] AS recent FROM t WHERE pos = 1
 UNION ALL SELECT t.chat_id, t.us, t.row_id, t.pos, s.block + {new}::INTEGER, CASE WHEN {new} THEN [t.terms] ELSE list_append(s.recent, t.terms)[-4:] END
 FROM s JOIN t ON t.chat_id = s.chat_id AND t.pos = s.pos + 1) SELECT chat_id, row_id, block FROM s"""


def strands(most: int) -> str:
    return f"""WITH RECURSIVE {TERMED},
s AS (SELECT chat_id, row_id, pos, 0 AS strand, 1 AS next, [{{'at': row_id, 'id': 0, 'terms': terms}}] AS open FROM t WHERE pos = 1
 UNION ALL SELECT chat_id, row_id, pos, home, next + (home = next)::INTEGER, list_sort(list_append(list_filter(open, lambda b: b.id <> home), {{'at': row_id, 'id': home, 'terms': terms}}))[-{most}:]
 FROM (SELECT *, CASE WHEN best.shared > 0 THEN best.id ELSE next END AS home
  FROM (SELECT t.chat_id, t.row_id, t.pos, t.terms, s.next, s.open, list_reverse_sort(list_transform(s.open, lambda b: {{'shared': len(list_intersect(b.terms, t.terms)), 'at': b.at, 'id': b.id}}))[1] AS best
   FROM s JOIN t ON t.chat_id = s.chat_id AND t.pos = s.pos + 1))) SELECT chat_id, row_id, strand FROM s"""


def bundles(window: int, span_us: int) -> str:
    mine = "{'id': %s, 'n': pos, 'us': us, 'terms': terms, 'object': %s}"
    return f"""WITH RECURSIVE {TERMED},
s AS (SELECT chat_id, row_id, pos, row_id AS bundle, [{mine % ('row_id', 'object')}] AS open FROM t WHERE pos = 1
 UNION ALL SELECT chat_id, row_id, pos, coalesce(home, row_id),
  CASE WHEN home IS NULL THEN list_append(live, {mine % ('row_id', 'object')}) ELSE list_transform(live, lambda b: CASE WHEN b.id = home THEN {mine % ('b.id', 'coalesce(object, b.object)')} ELSE b END) END
 FROM (SELECT *, list_filter(live, lambda b: list_has_any(b.terms, terms) AND (b.object IS NULL OR object IS NULL OR b.object = object))[-1].id AS home
  FROM (SELECT t.*, list_filter(s.open, lambda b: t.pos - b.n <= {window} AND t.us - b.us <= {span_us}) AS live
   FROM s JOIN t ON t.chat_id = s.chat_id AND t.pos = s.pos + 1))) SELECT chat_id, row_id, bundle FROM s"""


def parents(most: int) -> str:
    mine = "{'id': %s, 'terms': terms, 'object': object}"
    return f"""WITH RECURSIVE {TERMED},
s AS (SELECT chat_id, row_id, pos, [row_id] AS joined, [{mine % 'row_id'}] AS open FROM t WHERE pos = 1
 UNION ALL SELECT chat_id, row_id, pos, CASE WHEN len(fit) = 0 THEN [row_id] ELSE list_transform(fit, lambda b: b.id) END,
  CASE WHEN len(fit) = 0 THEN list_prepend({mine % 'row_id'}, open)[:{most}] ELSE list_transform(fit, lambda b: {mine % 'b.id'}) END
 FROM (SELECT t.*, s.open, list_filter(s.open, lambda b: list_has_any(b.terms, t.terms) AND (b.object IS NULL OR t.object IS NULL OR b.object = t.object))[:{most}] AS fit
  FROM s JOIN t ON t.chat_id = s.chat_id AND t.pos = s.pos + 1))
SELECT chat_id, row_id, unnest(joined) AS bundle, unnest(range(len(joined))) AS candidate_rank FROM s"""


def complete_link(edges: str, reach: int) -> str:
    return f"""WITH RECURSIVE {edges}, l AS (SELECT b AS id, list(a) AS linked FROM e GROUP BY b), t AS (SELECT p.chat_id, p.pos, p.row_id, coalesce(l.linked, []) AS linked FROM p LEFT JOIN l ON l.id = p.row_id),
s AS (SELECT chat_id, row_id, pos, row_id AS cluster, [{{'pos': pos, 'members': [row_id]}}] AS open FROM t WHERE pos = 1
 UNION ALL SELECT chat_id, row_id, pos, coalesce(home, row_id),
  CASE WHEN home IS NULL THEN list_append(live, {{'pos': pos, 'members': [row_id]}}) ELSE list_transform(live, lambda c: CASE WHEN c.members[1] = home THEN {{'pos': pos, 'members': list_append(c.members, row_id)}} ELSE c END) END
 FROM (SELECT *, list_filter(live, lambda c: list_has_all(linked, c.members))[1].members[1] AS home
  FROM (SELECT t.*, list_filter(s.open, lambda c: c.pos >= t.pos - {reach}) AS live
   FROM s JOIN t ON t.chat_id = s.chat_id AND t.pos = s.pos + 1))) SELECT row_id AS id, cluster FROM s"""


def batches(scopes: int, most: int) -> str:
    cut = f"(s.held > 0 AND s.held + least(t.n, {most}) > {most})"
    start = f"(CASE WHEN {cut} THEN 0 ELSE s.held END)"
    return f"""WITH RECURSIVE c AS (SELECT user_id % {scopes} AS scope, user_id AS chat_id, count(*) AS n FROM events GROUP BY user_id), t AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY chat_id) AS pos FROM c),
s AS (SELECT scope, chat_id, pos, n, 0 AS batch, n // {most} AS after, n % {most} AS held FROM t WHERE pos = 1
 UNION ALL SELECT t.scope, t.chat_id, t.pos, t.n, s.after + {cut}::INTEGER, s.after + {cut}::INTEGER + ({start} + t.n) // {most}, ({start} + t.n) % {most}
 FROM s JOIN t ON t.scope = s.scope AND t.pos = s.pos + 1) SELECT scope, chat_id, batch, n FROM s"""
