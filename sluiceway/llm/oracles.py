"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text, half a byte at a time; the table follows from the polynomial."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    listed = "[" + ", ".join(map(str, table)) + "]"
    half = f"xor(x >> 4, {listed}[(x & 15) + 1])"
    once = f"list_transform([xor(c, b)], lambda x: {half})[1]"
    twice = f"list_transform([{once}], lambda x: {half})[1]"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)), lambda c, b: {twice}), 4294967295)"


def merkle(fanout: int = 16, levels: int = 8) -> str:
    """The Merkle query for trees of up to `fanout ** levels` leaves."""

    def field(value: str) -> str:
        return f"coalesce(strlen(({value})::varchar) || ':' || ({value})::varchar, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"

    parts = [f"""leaves as (
  select doc_id, coalesce('s' || source, '') as tree, {leaf('text')} as leaf,
         case when doc_id is not null and {crc32("coalesce(doc_id, 0)::varchar")} % 5 = 0
              then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {leaf('text')} end as seen
  from documents)""",
        """a0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
  leaf as digest, count(*) over (partition by tree) as n from leaves)"""]

    def climb(name: str, start: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}{k + 1} as (
  select tree, pos // {fanout} as pos, (max(n) + {fanout - 1}) // {fanout} as n,
         case when max(n) = 1 then max(digest) else sha256(string_agg(digest, '' order by pos)) end as digest,
         list(digest order by pos) as kids
  from {start if k == 0 else f'{name}{k}'} group by tree, pos // {fanout})""")

    def path(name: str, own: str, place: str, size: str) -> list[str]:
        """Left and right siblings on every level, empty above the top."""
        steps = []
        for k in range(levels):
            slot, kids = f"({place} // {fanout ** k} % {fanout})", f"{name}{k + 1}.kids"
            real = f"{size} > {fanout ** k}"
            steps.append(f"struct_pack(used := {real}, l := array_to_string(list_slice({kids}, 1, {slot}), ''), r := array_to_string(list_slice({kids}, {slot} + 2, {fanout}), ''))")
        return steps

    climb("a", "a0")
    parts.append(f"b0 as (select tree as source_tree, '' as tree, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from a{levels})")
    climb("b", "b0")
    join_a = " ".join(f"join a{k + 1} on a{k + 1}.tree = a0.tree and a{k + 1}.pos = a0.pos // {fanout ** (k + 1)}" for k in range(levels))
    join_b = " ".join(f"join b{k + 1} on b{k + 1}.pos = b0.pos // {fanout ** (k + 1)}" for k in range(levels))
    parts.append(f"""proofs as (
  select doc_id, leaf, seen, b0.digest as subroot, b{levels}.digest as root,
         list_filter([{', '.join(path('a', 'a0', 'a0.pos', 'a0.n') + path('b', 'b0', 'b0.pos', 'b0.n'))}], lambda s: s.used) as path
  from a0 join b0 on b0.source_tree = a0.tree {join_a} {join_b})""")
    return "with " + ",\n".join(parts) + """
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) as proof_sha256,
       folded_root, folded_root = root as verified
from (select *, list_reduce(list_prepend(seen, list_transform(path, lambda s: s.l || '|' || s.r)),
        lambda up, s: sha256(split_part(s, '|', 1) || up || split_part(s, '|', 2))) as folded_root from proofs)"""


def prefix_trie(heads: int = 6, block: int = 100) -> str:
    """The trie query; subtree sums by joining every node to the nodes on its smallest member's way."""
    return f"""with turns as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
         row_number() over (partition by conv_id order by turn nulls first,
           md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
sizes as (select c, max(i) as n, {crc32('c::varchar')} % {heads} as h, c - c % {block} as b from turns group by c),
convs as (select s.c, s.b, s.h, least(s.h, coalesce(f.n, 0)) as k from sizes s left join sizes f on f.c = s.b),
rebuilt as (
  select convs.c, i as p, r, x from convs join turns on turns.c = convs.b and i <= k
  union all select convs.c, i - h + k, r, x from convs join turns on turns.c = convs.c and i > h),
members as (
  select c, p, sha256(string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '' order by p) over (partition by c order by p)) as path, length(x) as chars
  from rebuilt union all select c, 0, '', 0 from convs),
ends as (select c, max(p) as p from members group by c),
nodes as (
  select p, path, min(c) as o, count(*) as n_convs, max(chars) as chars,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where p = total), '')) as ends_sha256
  from (select m.*, e.p as total from members m join ends e using (c)) group by p, path),
edges as (select n.o, n.p, u.o as po from nodes n join members m on m.c = n.o and m.p = n.p - 1 join nodes u on u.p = m.p and u.path = m.path),
children as (select po as o, p - 1 as p, count(*) as n_children from edges group by po, p - 1),
own as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join children k using (o, p)),
sums as (
  select m.p, m.path, sum((d.n_children = 0)::bigint)::bigint as n_leaves, sum((d.n_convs - 1) * d.chars)::bigint as saved_tokens
  from own d join members m on m.c = d.o and m.p <= d.p group by m.p, m.path)
select own.o as conv_id, own.p as depth, edges.po as parent_conv_id, own.n_convs, own.n_children, sums.n_leaves, sums.saved_tokens, own.ends_sha256
from own join sums using (p, path) left join edges on edges.o = own.o and edges.p = own.p"""
