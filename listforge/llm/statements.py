"""DuckDB statements of the operators whose SQL is built from parts."""

#: The 256 remainders of CRC-32 as a list, worked out from its polynomial.
CRC_TABLE = """select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc"""


def crc32(codes: str) -> str:
    """CRC-32 of a list of byte values, by the list ``crc``; DuckDB has no such function."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])), 4294967295)"


def codes(text: str) -> str:
    """UTF-8 byte values of a text as a list of bigint."""
    def digit(at: str) -> str:
        return f"(instr('0123456789ABCDEF', hex({text})[{at}]) - 1)"
    return f"list_transform(range(1, 1 + strlen({text})), lambda i: 16 * {digit('2 * i - 1')} + {digit('2 * i')})"


def resampling() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))"
    return f"""with tab as materialized ({CRC_TABLE}),
        w as materialized (select row_number() over () as r, doc_id, 0 as side, {words} as w from documents union all select row_number() over (), null, 1, {words} from benchmark),
        f as materialized (select r, side, unnest({runs}) as f from w),
        b as materialized (select f, {crc32(codes("f"))} % 10000 as b from (select distinct f from f), tab),
        c as (select b, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from f join b using (f) group by b),
        g as (select b, cast(floor(1000 * ln(cast(t + 1 as double) * cast(sum(s) over () + 10000 as double) / (cast(s + 1 as double) * cast(sum(t) over () + 10000 as double)))) as bigint) as g from c),
        d as (select r, count(*) as n, cast(sum(g) as bigint) as weight from f join b using (f) join g using (b) where side = 0 group by r),
        h as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, len(w) as n_words,
          cast('0x' || sha256('42:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) as h from w left join d using (r) where side = 0),
        z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from h),
        o as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as o, count(*) filter (n_words >= 20) over () as able from z)
        select doc_id, n_features, weight, score, case when n_words >= 20 and o <= 5 * able // 100 then o end as rank from o"""


def trie() -> str:
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    return f"""with tab as materialized ({CRC_TABLE}),
        t as (select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || ':' || {words} as k from conversations where conv_id is not null),
        c as materialized (select conv_id, list(k order by turn nulls first, k) as own from t group by conv_id),
        h as (select c.conv_id, c.own, coalesce(b.own, []) as head, {crc32(codes("cast(c.conv_id as varchar)"))} % 4 as h
          from tab, c left join c b on b.conv_id = c.conv_id - c.conv_id % 20),
        p as (select conv_id, list_concat(head[1:h], own[h + 1:]) as p from h),
        m as (select p[1:d] as node, d as depth, conv_id, len(p) as l from p, unnest(range(0, len(p) + 1)) as u(d)),
        n as materialized (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id, ',' order by conv_id) filter (l = depth), '') as ends from m group by node, depth),
        k as (select node[1:depth - 1] as node, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
        x as materialized (select n.*, coalesce(n_children, 0) as n_children,
          case when n.depth = 0 then 0 else (n_convs - 1) * cast(split_part(n.node[n.depth], ':', 2) as bigint) end as saved from n left join k using (node, depth)),
        s as (select node[1:d] as node, d as depth, count(*) filter (n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens from x, unnest(range(0, depth + 1)) as u(d) group by all)
        select x.conv_id, x.depth, y.conv_id as parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) as ends_sha256
        from x join s using (node, depth) left join n y on y.depth = x.depth - 1 and y.node = x.node[1:x.depth - 1]"""


def rules() -> str:
    """Every rule over the whole table; the order of the cascade cannot change a verdict."""
    return r"""with w as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
        x as (select r, pos, array_to_string(w[pos:pos + 7], ' ') as win from w, unnest(range(1, len(w) - 6)) as u(pos)),
        y as (select r, unnest(range(pos, pos + 8)) as pos from x qualify count(*) over (partition by r, win) > 1),
        z as (select r, count(distinct pos) as n from y group by r),
        s as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
          len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines,
          length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) as letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper from w left join z using (r))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
          not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 4 * n_lines
            or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * letters < word_chars or 2 * upper > letters) as kept from s"""
