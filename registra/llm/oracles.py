"""DuckDB SQL for the corpus queries that SQL can express."""

LINES = """with split as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
    l as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split),
    k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
    shared as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
    j as (select k.doc_id, pos, line, shared.key is not null and k.doc_id < shared.last as gone from k left join shared on shared.key = k.key)
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from j group by doc_id"""

# crc32 by bits; prefixes as lists of turns; a node's subtree by all prefixes of its nodes' smallest members
TRIE = """with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, unhex(md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) - 1 as pos from conversations where conv_id is not null),
    ids as (select c, c - c % 20 as base, xor(list_reduce(list_transform(range(strlen(cast(c as varchar))), lambda i: cast(ascii(substr(cast(c as varchar), i + 1, 1)) as ubigint)),
    lambda a, b: list_reduce(range(8)::ubigint[], lambda s, x: xor(s >> 1, 3988292384::ubigint * (s & 1::ubigint)), xor(a, b)), 4294967295::ubigint), 4294967295::ubigint) % 4 as h from (select distinct c from t)),
    r as (select ids.c, 0 as own, pos, role, text from ids join t on t.c = ids.base and t.pos < h union all select ids.c, 1, pos, role, text from ids join t on t.c = ids.c and t.pos >= h),
    o as (select c, row_number() over (partition by c order by own, pos) as depth, sha256(strlen(role) || ':' || role || text) as part, text from r),
    p as (select c, depth, text, sha256(string_agg(part, '') over (partition by c order by depth)) as key from o union all select c, 0, '', '' from ids),
    s as (select *, lag(key) over (partition by c order by depth) as up, depth = max(depth) over (partition by c) as last from p),
    n as (select min(c) as conv_id, depth, key, min(up) as up, count(*) as n_convs, len(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')) as words,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (last), '')) as ends_sha256 from s group by depth, key),
    kids as (select depth - 1 as depth, up as key, count(*) as n from n where depth > 0 group by 1, 2),
    f as (select n.*, coalesce(kids.n, 0) as n_children from n left join kids on kids.depth = n.depth and kids.key = n.key),
    total as (select a.depth, a.key, sum(case when f.n_children = 0 then 1 else 0 end) as leaves, sum((f.n_convs - 1) * f.words) as saved from f join s a on a.c = f.conv_id and a.depth <= f.depth group by 1, 2)
    select f.conv_id, cast(f.depth as bigint) as depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, f.ends_sha256
    from f join total on total.depth = f.depth and total.key = f.key left join f u on u.depth = f.depth - 1 and u.key = f.up"""
