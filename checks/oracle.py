"""The DuckDB statement for each query, written from common table expressions."""

from listforge.functions import fixed

from .tables import LINEITEM_LISTINGS, LINEITEM_ORDER, PART_LISTINGS, PLAIN, REQUESTS, SAID, WRONG

_TITLE = (
    r"array_to_string(list_transform(regexp_extract_all(lower({0}), "
    r"'([\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+)'), lambda w: upper(w[1:1]) || w[2:]), '')"
)


def _title(x):
    return _TITLE.format(x)


_LOCATION = f"nullif({_title(r'''regexp_replace(trim(location), '\s+', ' ', 'g')''')}, '')"
_CUISINES = f"coalesce(list_filter(list_transform(string_split(cuisines, ','), lambda s: {_title('trim(s)')}), lambda s: s <> ''), [])"
_RATING = r"try_cast(regexp_replace(trim(rate), '\s*/\s*5.*', '', 'g') as double)"
_COST = r"try_cast(nullif(regexp_replace(cost, '[^\d.]', '', 'g'), '') as double)"
_TIER = "case when cost_for_two < 500 then 'low' when cost_for_two <= 1500 then 'medium' when cost_for_two > 1500 then 'high' end"


def _catalog(raw):
    return f"""select row_number() over (order by src_key) as id, name, location, cuisines,
  case when r between 0 and 5 then r end as rating, cost_for_two, {_TIER} as budget
  from (select src_key, trim(name) as name, {_LOCATION} as location, {_CUISINES} as cuisines,
    {_RATING} as r, {_COST} as cost_for_two from {raw})"""


def _clean_item(rating):
    return f"round({rating}, 1)"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _explained(said):
    for text in fixed.EXPLANATION_REMOVALS:
        said = f"replace({said}, {_quoted(text)}, '')"
    return rf"regexp_replace({said}, {_quoted(fixed.TRAILING_ZERO)}, '\1', 'g')"


def _patched(text, n):
    def sub(c, pattern, replacement):
        return f"regexp_replace({c}, {_quoted(pattern)}, '{replacement}', 'gi')"

    def count(word):
        one = word == fixed.COUNT_WORDS[1]
        found = (fixed.ONE_RECOMMENDATION, fixed.ONE_MATCH) if one else (fixed.MANY_RECOMMENDATIONS, fixed.MANY_MATCHES)
        said = ("one recommendation", "one match") if one else (rf"{word}\2",) * 2
        return sub(sub(sub(text, found[0], said[0]), found[1], said[1]), fixed.TOP_COUNT, f"top {word}")

    cases = " ".join(f"when {i} then {count(fixed.COUNT_WORDS.get(i, str(i)))}" for i in range(1, 7))
    return f"case {n} when 0 then {text} {cases} end"


_FACTS = f"""select count(*) as n, count(*) - count(distinct id) as extra, count(*) filter (name is null) as null_name,
        count(*) filter (location is null) as null_location, count(*) filter (rating is null) as null_rating,
        count(*) filter (cost_for_two is null) as null_cost, count(*) filter (budget is null) as null_budget,
        count(*) filter (cuisines is null) as null_cuisines, count(*) filter (id is null) as null_id,
        count(*) filter (rating not between 0 and 5) as bad_rating, count(*) filter (len(cuisines) = 0) as no_cuisine,
        count(*) filter (budget not in ('low', 'medium', 'high')) as bad_tier,
        count(*) filter (budget <> {_TIER}) as differs from {{table}}"""


_CTES = {
    "raw": (PART_LISTINGS.format(part="part", nation="nation"), []),
    "cat": (_catalog("raw"), ["raw"]),
    "numbered": (f"select row_number() over (order by {', '.join(LINEITEM_ORDER)}) as src_key, l_partkey from lineitem", []),
    "lraw": (LINEITEM_LISTINGS.format(numbered="numbered", part="part", nation="nation"), ["numbered"]),
    "lcat": (_catalog("lraw"), ["lraw"]),
    "asked": (REQUESTS.format(events="events"), []),
    "checked": ("""select request_id, location, cuisine, min_rating, budget,
        list_filter([case when coalesce(location = '', true) then 'location' end, case when coalesce(cuisine = '', true) then 'cuisine' end,
         case when coalesce(not min_rating between 0 and 5, true) then 'min_rating' end,
         case when coalesce(budget not in ('low', 'medium', 'high'), true) then 'budget' end], lambda e: e is not null) as errors
        from (select request_id, trim(location) as location, trim(cuisine) as cuisine,
          case when min_rating is null then 0.0::double else try_cast(min_rating as double) end as min_rating, budget from asked)""", ["asked"]),
    "req": ("select * exclude (errors) from checked where len(errors) = 0", ["checked"]),
    "found": ("""select r.request_id, r.min_rating, c.* from req r join cat c on c.budget = r.budget and c.rating >= r.min_rating
        and contains(lower(c.location), lower(r.location))
        and len(list_filter(c.cuisines, lambda x: contains(lower(x), lower(r.cuisine)))) > 0""", ["req", "cat"]),
    "sl": ("""select * from (select *, cast(row_number() over (partition by request_id order by rating desc, id) as integer) as pos
        from found) where pos <= 40""", ["found"]),
    "sized": ("""select r.*, r.request_id % 8 as way, coalesce(n, 0) as n from req r
        left join (select request_id, count(*) as n from sl group by request_id) using (request_id)""", ["req", "sl"]),
    "kinds": ("""select *, case when n = 0 then 'empty' when way = 7 then 'unavailable' when way in (3, 4, 6) then 'failed' else 'scored' end as kind
        from sized""", ["sized"]),
    "good": ("""select k.request_id, cast(least(n, 6) - pos + 2 as integer) as rec_pos, cast(pos as bigint) as rank, s.id, s.name, s.cuisines, s.rating, s.cost_for_two,
        'AI: rated ' || cast(rating as varchar) || ' for ' || cast(cost_for_two as varchar) as said
        from kinds k join sl s using (request_id) where kind = 'scored' and way in (0, 1, 2) and pos <= 6""", ["kinds", "sl"]),
    "kept": ("select * from (select *, row_number() over (partition by request_id order by rec_pos) as nth from good) where nth <= 5", ["good"]),
    "backup": (f"""select k.request_id, pos as rec_pos, cast(pos as bigint) as rank, s.id, s.name, s.cuisines, s.rating, s.cost_for_two,
        case kind when 'unavailable' then {_quoted(fixed.UNAVAILABLE_EXPLANATION)} else {_quoted(fixed.FAILED_EXPLANATION[0])} || cast(rating as varchar) || {_quoted(fixed.FAILED_EXPLANATION[1])} end as said
        from kinds k join sl s using (request_id) where kind in ('unavailable', 'failed') and pos <= 5""", ["kinds", "sl"]),
    "recs": ("select * exclude (nth) from kept union all select * from backup", ["kept", "backup"]),
    "items": (f"""select request_id, rec_pos, rank, id, name, cuisines, {_clean_item('rating')} as rating, trunc(cost_for_two) as cost_for_two,
        {_explained('said')} as explanation from (select *, row_number() over
        (partition by request_id, lower(trim(name)) order by rec_pos) as seen from recs) where seen = 1""", ["recs"]),
    "counted": (f"""select k.*, cast(coalesce(m, 0) as integer) as n_items, case kind when 'empty' then {_quoted(fixed.EMPTY_SUMMARY[0])} || location || {_quoted(fixed.EMPTY_SUMMARY[1])}
        when 'unavailable' then {_quoted(fixed.UNAVAILABLE_SUMMARY)}
        when 'failed' then {_quoted(fixed.FAILED_SUMMARY)}
        else case way when 5 then '{SAID}' else '{SAID}' end end as said
        from kinds k left join (select request_id, count(*) as m from items group by request_id) using (request_id)""", ["kinds", "items"]),
    "told": (f"select request_id, n_items, {_patched('said', 'n_items')} as summary from counted", ["counted"]),
    "bodies": (f"""select r.request_id, '{{"summary":"{SAID}","recommendations":[{{"restaurant_id":-1,"rank":9,"explanation":"AI: unknown"}}' as head,
        coalesce(string_agg(',{{"restaurant_id":' || id || ',"rank":' || pos || ',"explanation":"AI: rated ' || cast(rating as varchar)
          || ' for ' || cast(cost_for_two as varchar) || '"}}', '' order by pos desc), '') as tail
        from req r left join (select * from sl where pos <= 6) using (request_id) group by r.request_id""", ["req", "sl"]),
    "resp": (f"""select request_id, cast(a.attempt as integer) as attempt,
        case a.kind when 'good' then head || tail || ']}}' when 'lost' then head || ']}}' when 'list' then '[' || head || tail || ']}}]'
          when 'plain' then '{PLAIN}' when 'wrong' then '{WRONG}' end as raw,
        case a.kind when 'error' then 'timeout' end as error, a.kind as kind
        from bodies join (values (0, 0, 'good'), (1, 0, 'plain'), (1, 1, 'good'), (2, 0, 'wrong'), (2, 1, 'good'), (3, 0, 'plain'),
          (3, 1, 'plain'), (3, 2, 'plain'), (4, 0, 'error'), (4, 1, 'good'), (5, 0, 'lost'), (6, 0, 'list'), (6, 1, 'good'))
          a(way, attempt, kind) on request_id % 8 = a.way""", ["bodies"]),
    "newer": ("""select * replace (case when id % 11 = 0 then rating / 2 else rating end as rating) from cat
        where id % 7 <> 0 and not coalesce(location = 'Nation 1' and id % 10 <> 3, location is null)
        union all select * replace (id + 1000000 as id, least(rating + 0.25, 5.0) as rating) from cat where id % 13 = 0""", ["cat"]),
    "later": (_catalog("""(select src_key, name, location, cuisines, case when src_key % 11 = 0 then '4.9/5' else rate end as rate, cost from raw where src_key % 7 <> 0
        union all select src_key + 1000000, 'new ' || src_key, location, cuisines, rate, cost from raw where src_key % 13 = 0)""").replace("select row_number() over (order by src_key) as id,", "select src_key,"), ["raw"]),
    "ids": ("""select *, row_number() over (partition by name, location, cuisines, rating, cost_for_two, budget order by id) as nth from cat""", ["cat"]),
    "again": ("""select *, row_number() over (partition by name, location, cuisines, rating, cost_for_two, budget order by src_key) as nth from later""", ["later"]),
    "told_ids": ("""select a.*, i.id from again a left join ids i on a.name = i.name and a.nth = i.nth and a.cuisines = i.cuisines
        and a.location is not distinct from i.location and a.rating is not distinct from i.rating
        and a.cost_for_two is not distinct from i.cost_for_two and a.budget is not distinct from i.budget""", ["again", "ids"]),
    "facts": (_FACTS.format(table="cat"), ["cat"]),
    "grown": ("select * from cat union all select * from cat where id % 3 = 0", ["cat"]),
    "grown_facts": (_FACTS.format(table="grown"), ["grown"]),
}


def _with(final, *names):
    needed = []

    def add(name):
        for dep in _CTES[name][1]:
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    parts = ", ".join(f"{n} as materialized ({_CTES[n][0]})" for n in needed)
    return f"with {parts} {final}"


_TEXT = "array_to_string({0}, '|')"
_CAT_COLUMNS = f"id, name, location, {_TEXT.format('cuisines')} as cuisines, rating, cost_for_two, budget"


def _cell(column, cleaned):
    return _with(f"select src_key + 1 as id, {column} as raw_value, {cleaned} as cleaned from raw", "raw")


def _rules(facts="facts"):
    columns = {"id": "id", "name": "name", "location": "location", "cuisines": "cuisines", "rating": "rating",
               "cost_for_two": "cost", "budget": "budget"}
    pct = lambda c: f"round({c} * 100.0::double / n, 6)"
    rules = [
        ("non_empty", "error", "n", 0, "n = 0"),
        ("duplicate_ids", "error", "extra", 0, "extra > 0"),
        ("missing_columns", "error", "0", 0, "false"),
        *[(f"null_pct_{c}", "warning", pct(f"null_{s}"), 50, f"null_{s} * 100.0 > 50 * n") for c, s in columns.items()],
        ("rating_out_of_range", "warning", "bad_rating", 0, "bad_rating > 0"),
        ("no_tier_pct", "warning", pct("null_budget"), 50, "null_budget * 100.0 > 50 * n"),
        ("no_cuisine_pct", "warning", pct("no_cuisine"), 30, "no_cuisine * 100.0 > 30 * n"),
        ("min_rows", "check", "n", 1000, "n < 1000"),
        ("null_names", "check", "null_name", 0, "null_name > 0"),
        ("null_locations_pct", "check", pct("null_location"), 1, "null_location * 100.0 >= n"),
        ("unknown_tiers", "check", "bad_tier", 0, "bad_tier > 0"),
        ("tier_cost_mismatch", "check", "differs", 0, "differs > 0"),
    ]
    rows = " union all ".join(
        f"select '{r}' as rule, '{s}' as severity, cast({v} as double) as value, cast({t} as double) as threshold, {f} as failed from {facts}"
        for r, s, v, t, f in rules)
    return _with(rows, facts)


_P_LOC = "contains(lower(coalesce(location, '')), 'nation 1')"
_P_CUI = "len(list_filter(cuisines, lambda x: contains(lower(x), 'econ'))) > 0"
_P_RAT = "rating >= 2"
_P_BUD = "budget = 'medium'"
_STAGE = "case when n_location = 0 then 'location' when n_cuisine = 0 then 'cuisine' when n_rating = 0 then 'rating' when n_budget = 0 then 'budget' end as empty_stage"
_ONE = "select cast(row_number() over (order by rating desc, id) as integer) as pos, id, name, rating, budget from cat where {0} order by pos limit 40"


def _sorted(key):
    return _with(
        f"select request_id, cast(row_number() over (partition by request_id order by {key}, rank, rec_pos) as integer) as pos, id from items",
        "items")


_GAPS = """(select id // 4 as request_id, id % 4 + 1 as rank, id, case id % 3 when 0 then null when 1 then 0.0 else rating end as rating,
    case id % 5 when 0 then null when 1 then 0.0 else cost_for_two end as cost_for_two from cat)"""


def _sorted_gaps(key):
    return _with(f"select request_id, cast(row_number() over (partition by request_id order by {key}, rank) as integer) as pos, id from {_GAPS}", "cat")


def _null_rates():
    return _with(" union all ".join(
        f"select '{c}' as column_name, round(avg(cast({c} is null as integer)) * 100, 6) as null_pct from cat"
        for c in ["id", "name", "location", "cuisines", "rating", "cost_for_two", "budget"]), "cat")


def _shortlist_json(struct):
    return f"to_json(list({struct} order by pos))"


def all_sql() -> dict[str, str]:
    cuisines = _TEXT.format("cuisines")
    return {
        "raw_listings": _with("select * from raw", "raw"),
        "clean_catalog": _with(f"select {_CAT_COLUMNS} from cat", "cat"),
        "clean_catalog_aliases": _with(f"select {_CAT_COLUMNS} from cat", "cat"),
        "clean_catalog_csv_order": _with(
            f"select row_number() over (order by src_key) as id, trim(case when src_key % 3 = 0 then name || ',' || chr(10) || '\"' || src_key || '\"' else name end) as name, "
            f"location, {_TEXT.format('cuisines')} as cuisines, rating, cost_for_two, budget from (select r.name, src_key, location, cuisines, rating, cost_for_two, budget from "
            "(select src_key, name from raw) r join (select id, location, cuisines, rating, cost_for_two, budget from cat) c on c.id = r.src_key + 1)", "raw", "cat"),
        "clean_catalog_lineitem": _with(f"select {_CAT_COLUMNS} from lcat", "lcat"),
        # The file holds its rows in key order.
        "clean_catalog_input_order": (
            f"select *, {_TIER} as budget from (select row_number() over (order by p_partkey) as id, trim(p_name) as name, "
            f"{_title('p_brand')} as location, {_title('p_type')} as cuisines, cast(case when p_size between 0 and 5 then p_size end as double) as rating, "
            "abs(p_retailprice) as cost_for_two from part)"),
        "clean_catalog_input_order_filtered": (
            f"select *, {_TIER} as budget from (select row_number() over (order by p_partkey) as id, trim(p_name) as name, "
            f"{_title('p_brand')} as location, {_title('p_type')} as cuisines, cast(case when p_size between 0 and 5 then p_size end as double) as rating, "
            "abs(p_retailprice) as cost_for_two from part where p_size % 3 <> 1)"),
        "ingest_published": _with(
            "select count(*) as n_rows, min(id) as first_id, max(id) as last_id, count(distinct id) as n_ids, "
            f"(select coalesce(string_agg(rule, ',' order by rule), '') from ({_rules()}) where failed) as failed from cat", "cat"),
        "null_rates_nan": _null_rates(),
        "quality_report_nan": _rules(),
        "catalog_columns": "select * from (values ('id', 'bigint'), ('name', 'string'), ('location', 'string'), ('cuisines', 'array<string>'), "
                           "('rating', 'double'), ('cost_for_two', 'double'), ('budget', 'string')) t(column_name, type)",
        "round_hundredths": "select *, cast(format('{:.1f}', raw_value) as double) as cleaned from "
                            "(select p_partkey as id, cast(p_partkey % 501 as double) / 100 as raw_value from part)",
        "clean_catalog_defaults": _with(
            f"select id, 'Unknown' as name, location, {cuisines} as cuisines, cast(null as double) as rating, "
            "cast(null as double) as cost_for_two, cast(null as varchar) as budget from cat", "cat"),
        "catalog_roundtrip": _with("select count(*) as n_rows, count(distinct id) as n_ids, sum(cost_for_two) as sum_cost from cat", "cat"),
        "clean_rating": _cell("rate", f"case when {_RATING} between 0 and 5 then {_RATING} end"),
        "clean_cost": _cell("cost", _COST),
        "clean_cuisines": _cell("cuisines", _TEXT.format(_CUISINES)),
        "normalize_location": _cell("location", _LOCATION),
        "assign_budget": _with(f"select id, cost_for_two as raw_value, {_TIER} as cleaned from cat", "cat"),
        "quality_report": _rules(),
        "null_rates": _null_rates(),
        "duplicate_ids_dense": _with(
            "select way, n from (select count(*) - count(distinct id) as n from (select [1, 3, 4, 5, 8, 9, 3, 4, 8][(id - 1) % 9 + 1] + (id - 1) // 9 * 9 as id "
            "from cat where id <= (select count(*) // 9 * 9 from cat))), (values ('bits'), ('ids'), ('numbered'), ('foreign')) v(way)", "cat"),
        "budget_counts": _with("select budget, count(*) as n from cat where budget is not null group by budget", "cat"),
        "budget_counts_with_null": _with("select budget, count(*) as n from cat group by budget", "cat"),
        "rating_summary": _with(
            "select count(rating) as count, round(avg(rating), 6) as mean, round(stddev_samp(rating), 6) as std, min(rating) as min, "
            "round(quantile_cont(rating, 0.25), 6) as q25, round(quantile_cont(rating, 0.5), 6) as q50, "
            "round(quantile_cont(rating, 0.75), 6) as q75, max(rating) as max from cat", "cat"),
        "top_locations": _with(
            "select cast(row_number() over (order by n desc, location) as integer) as pos, location, n from "
            "(select location, count(*) as n from cat where location is not null group by location) order by pos limit 10", "cat"),
        "catalog_preview": _with(
            f"select id, name[1:40] as name, location[1:20] as location, {_TEXT.format('cuisines[1:2]')} as cuisines, rating, cost_for_two, budget "
            "from cat where id <= 5", "cat"),
        "options_locations": _with("select row_number() over (order by value) as pos, value from "
                                   "(select distinct location as value from cat where location is not null)", "cat"),
        "options_cuisines": _with("select row_number() over (order by value) as pos, value from "
                                  "(select distinct unnest(cuisines) as value from cat)", "cat"),
        "options_payload": _with(
            "select kind, cast((pos - 1) // 1000 + 1 as bigint) as page, string_agg(value, '|' order by pos) as options from ("
            "select 'locations' as kind, row_number() over (order by value) as pos, value from (select distinct location as value from cat where location is not null) "
            "union all select 'cuisines', row_number() over (order by value), value from (select distinct unnest(cuisines) as value from cat)) "
            "group by kind, 2", "cat"),
        "filter_location": _with(f"select id, location from cat where {_P_LOC}", "cat"),
        "filter_cuisine": _with(f"select id, {cuisines} as cuisines from cat where {_P_CUI}", "cat"),
        "filter_rating": _with("select id, rating from cat where rating >= 0", "cat"),
        "filter_budget": _with(f"select id, budget from cat where {_P_BUD}", "cat"),
        "filter_funnel": _with(
            f"select *, {_STAGE} from (select count(*) as n_all, count(*) filter ({_P_LOC}) as n_location, count(*) filter ({_P_LOC} and {_P_CUI}) as n_cuisine, "
            f"count(*) filter ({_P_LOC} and {_P_CUI} and {_P_RAT}) as n_rating, "
            f"count(*) filter ({_P_LOC} and {_P_CUI} and {_P_RAT} and {_P_BUD}) as n_budget from cat)", "cat"),
        "filter_funnel_batch": _with(
            f"""select *, {_STAGE} from (select r.request_id, (select count(*) from cat) as n_all, count(c.id) as n_location,
            count(*) filter (hit) as n_cuisine, count(*) filter (hit and rating >= min_rating) as n_rating,
            count(*) filter (hit and rating >= min_rating and c_budget = budget) as n_budget
            from req r left join (select w.place, w.dish, c.id, c.rating, c.budget as c_budget,
              len(list_filter(c.cuisines, lambda x: contains(lower(x), w.dish))) > 0 as hit
              from (select distinct lower(location) as place, lower(cuisine) as dish from req) w join cat c on contains(lower(c.location), w.place)) c
            on c.place = lower(r.location) and c.dish = lower(r.cuisine) group by r.request_id)""", "req", "cat"),
        "shortlist_one": _with(_ONE.format(f"{_P_LOC} and {_P_CUI} and {_P_RAT} and {_P_BUD}"), "cat"),
        "shortlist_published": _with(_ONE.format(f"{_P_LOC} and {_P_CUI} and {_P_RAT} and {_P_BUD}"), "cat"),
        "filter_location_published": _with(f"select id, location from cat where {_P_LOC}", "cat"),
        "quality_from_facts": _rules("grown_facts"),
        "rating_summary_from_facts": _with(
            "select count(rating) as count, round(avg(rating), 6) as mean, round(stddev_samp(rating), 6) as std, min(rating) as min, "
            "round(quantile_cont(rating, 0.25), 6) as q25, round(quantile_cont(rating, 0.5), 6) as q50, "
            "round(quantile_cont(rating, 0.75), 6) as q75, max(rating) as max from cat", "cat"),
        "shortlist_empty": _with(_ONE.format(f"contains(lower(location), 'no such place') and {_P_CUI} and {_P_RAT} and {_P_BUD}"), "cat"),
        "shortlist_after_delta": _with(
            """select request_id, cast(row_number() over (partition by request_id order by rating desc, id) as integer) as pos, id, rating from
            (select r.request_id, c.id, c.rating from req r join newer c on c.budget = r.budget and c.rating >= r.min_rating and contains(lower(c.location), lower(r.location))
              and len(list_filter(c.cuisines, lambda x: contains(lower(x), lower(r.cuisine)))) > 0) qualify pos <= 40""", "req", "newer"),
        "ids_after_reingest": _with(
            """select id, name, rating, false as gone from told_ids where id is not null
            union all select (select count(*) from cat) + row_number() over (order by src_key), name, rating, false from told_ids where id is null
            union all select id, null, null, true from cat where id not in (select id from told_ids where id is not null)""", "told_ids", "cat"),
        "shortlist_batch_broad": _with(
            """select request_id, cast(row_number() over (partition by request_id order by rating desc, id) as integer) as pos, id, rating from
            (select request_id, x[request_id % 8 + 1] as place, x[(request_id // 8) % 8 + 1] as dish, min_rating, budget
              from req, (select ['a', 'n', 'i', 'o', 'at', 'on', 'na', 'ti'] as x)) r join cat c using (budget)
            where rating >= min_rating and contains(lower(location), place) and len(list_filter(cuisines, lambda x: contains(lower(x), dish))) > 0
            qualify pos <= 40""", "req", "cat"),
        "scored_by_hook": _with(
            "select request_id, cast(0 as integer) as attempt, count(*) || ' candidates' as summary, max(id) filter (pos = 1) as restaurant_id, "
            "cast(1 as bigint) as rank, max(name) filter (pos = 1) as explanation from sl group by request_id", "sl"),
        "scored_in_rounds": _with(
            """select request_id, attempt, case when mood = 3 and attempt = 1 then 'TimeoutError: no answer' end as error,
              case when mood = 3 and attempt = 1 then 'stop' when mood < 3 and attempt = mood then 'ok' else 'retry' end as status,
              case when mood < 3 and attempt = mood then first end as restaurant_id
            from (select request_id, min(id) filter (pos = 1) as first, min(id) filter (pos = 1) % 5 as mood from sl group by request_id)
            join (select cast(range as integer) as attempt from range(3)) on attempt <= case mood when 3 then 1 when 4 then 2 else mood end""", "sl"),
        "sort_price_asc_gaps": _sorted_gaps("coalesce(nullif(cost_for_two, 0), 'infinity')"),
        "sort_price_desc_gaps": _sorted_gaps("-coalesce(cost_for_two, 0)"),
        "sort_rating_desc_gaps": _sorted_gaps("-coalesce(rating, 0)"),
        "display_labels_gaps": _with(
            "select request_id, id, coalesce('₹' || cast(cast(cost_for_two as bigint) as varchar) || ' for two', 'Price N/A') as price, "
            f"printf('%.1f', rating) as rating from {_GAPS}", "cat"),
        "shortlist_batch": _with("select request_id, pos, id, name, rating from sl", "sl"),
        "requests_valid": _with("select * from req", "req"),
        "requests_rejected": _with(f"select request_id, {_TEXT.format('errors')} as errors from checked where len(errors) > 0", "checked"),
        "requests_json": _with(
            """select request_id, location, min_rating, array_to_string(list_filter([case when location = '' then 'location' end, case when cuisine = '' then 'cuisine' end,
              case when request_id % 7 in (1, 4, 5, 6) then 'min_rating' end, case when budget not in ('low', 'medium', 'high') then 'budget' end], lambda e: e is not null), '|') as errors
            from (select request_id, trim(location) as location, trim(cuisine) as cuisine, budget,
              cast(case request_id % 7 when 0 then 0 when 2 then 3.5 when 3 then 4 when 6 then 6 end as double) as min_rating from asked)""", "asked"),
        "outer_errors": _with(
            """select request_id, kind, cast(case when kind in ('failed', 'unavailable') then least(n, 5) end as integer) as n_recs from (
              select request_id, n, case when n = 0 then 'empty' when request_id % 3 = 0 then 'error' when request_id % 3 = 1 then 'failed' else 'unavailable' end as kind from sized)""", "sized"),
        "catalog_size": _with("select count(distinct coalesce(budget, '')) as n_files, true as sized from cat", "cat"),
        "requests_summary": _with(
            "select request_id, 'location=''' || location || '''  cuisine=''' || cuisine || '''  min_rating=' || cast(min_rating as varchar) "
            "|| '  budget=''' || budget || '''' as summary from req", "req"),
        "prompt_payload": _with(
            r"""select r.request_id, 'Request' || chr(10) || '- place: ' || r.location || chr(10) || '- cuisine: ' || r.cuisine || chr(10)
            || '- lowest rating: ' || cast(r.min_rating as varchar) || chr(10) || '- price tier: ' || r.budget || chr(10) || chr(10)
            || 'Candidates (JSON)' || chr(10) || j || chr(10) || chr(10)
            || 'Choose at most five candidates, best first, and answer with one JSON object only:' || chr(10)
            || '{"summary": text, "recommendations": [{"restaurant_id": whole number, "rank": whole number from 1, "explanation": text}]}' || chr(10) as prompt
            from req r join (select request_id, """
            + _shortlist_json("struct_pack(id := id, name := name, location := location, cuisines := cuisines, rating := rating, "
                              "cost_for_two := cost_for_two, budget := budget)")
            + " as j from sl group by request_id) using (request_id)", "req", "sl"),
        "responses_fixture": _with("select request_id, attempt, raw, error from resp", "resp"),
        "parse_responses": _with(
            "select request_id, attempt, case kind when 'good' then 'ok' when 'lost' then 'ok' when 'error' then 'stop' when 'list' then 'stop' "
            "else 'retry' end as status from resp", "resp"),
        "first_valid_attempt": _with(
            "select request_id, cast(case when request_id % 8 in (0, 5) then 0 else 1 end as integer) as attempt from req "
            "where request_id % 8 in (0, 1, 2, 5)", "req"),
        "valid_recs": _with("select request_id, rec_pos, id as restaurant_id, rank from kept", "kept"),
        "hallucinated_recs": _with(
            "select request_id, cast(1 as integer) as rec_pos, cast(-1 as bigint) as restaurant_id, cast(9 as bigint) as rank "
            "from kinds where kind = 'scored'", "kinds"),
        "fallback_recs": _with(
            "select k.request_id, kind, id as restaurant_id, rank, said as explanation from kinds k left join backup using (request_id) "
            "where kind <> 'scored'", "kinds", "backup"),
        "recommend_items": _with(
            f"select request_id, rec_pos, rank, id, name, {cuisines} as cuisines, rating, cost_for_two, explanation from items", "items"),
        "clean_explanation": _with(
            "select id, " + _explained("('AI: ' || name || ' has 4.05 of 5.00, cost ' || coalesce(cast(cost_for_two as varchar), 'AI:?'))")
            + " as explanation from cat", "cat"),
        "summary_patch": _with(
            "select request_id, n_items, " + _patched("said", "n_items") + " as summary from (select request_id, cast(request_id % 7 as integer) as n_items, "
            "'Top ' || (request_id % 9) || ' picks: someone found FIVE great Recommendations and two matches, top three, one Match' as said from req)", "req"),
        "recommend_summary": _with("select * from told", "told"),
        "recommend_payload": _with(
            "select t.request_id, t.summary, cast(coalesce(j, '[]') as varchar) as items from told t left join (select request_id, "
            "to_json(list(struct_pack(name := name, cuisines := cuisines, rating := rating, cost_for_two := cost_for_two, "
            "explanation := explanation, rank := rank) order by rank, rec_pos)) as j from items group by request_id) using (request_id)",
            "told", "items"),
        "sort_rank": _with(
            "select *, pos = 1 as is_top_pick from (select request_id, cast(row_number() over (partition by request_id order by rank, rec_pos) as integer) as pos, id from items)",
            "items"),
        "sort_price_asc": _sorted("coalesce(nullif(cost_for_two, 0), 'infinity'::double)"),
        "sort_price_desc": _sorted("coalesce(cost_for_two, 0) desc"),
        "sort_rating_desc": _sorted("coalesce(rating, 0) desc"),
        "display_cuisines": _with(
            f"""select request_id, id, array_to_string(case when hit > 0 then ([cuisines[hit]] || cuisines[1:hit - 1] || cuisines[hit + 1:])[1:3] else cuisines[1:3] end, '|') as cuisines
            from (select i.*, coalesce(list_position(list_transform(i.cuisines, lambda x: lower(x)), lower(r.cuisine)), 0) as hit
            from items i join req r using (request_id))""", "items", "req"),
        "display_labels": _with(
            "select request_id, id, '₹' || cast(cast(cost_for_two as bigint) as varchar) || ' for two' as price, "
            "printf('%.1f', rating) as rating from items", "items"),
    }
