"""DuckDB SQL with the same result as the query of the same name, over whole tables."""
from __future__ import annotations

from itertools import combinations

from entry_queries.inputs import ctes
from pitchframe.functions.text import POSITION_GROUPS, TEAM_ALIASES
from pitchframe.operators.features import FORM, XG
from pitchframe.operators.ratings import PRIOR_GOALS, RATING_COLUMNS

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_values = lambda pairs: ", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in pairs.items())
_blank = "trim({0}, ' \t\r\n\f\v')"
_is_blank = "({0} is null or " + _blank + " in ('', 'nan', 'None', '<NA>'))"
_number = (
    "case when regexp_full_match(" + _blank + r", '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
    " then cast(" + _blank + " as double) end"
)


def _round(expression: str, places: int = 6) -> str:
    return f"round_even(cast({expression} as double), {places})"


def _rounded(columns, prefix: str = "") -> str:
    return ", ".join(f"{_round(prefix + c)} as {c}" for c in columns)


# --- building blocks, each a list of further "with" members ---

ALIASES = f", alias_names(alias, canonical) as (values {_values(TEAM_ALIASES)})"


def _canonical(column: str) -> str:
    name = _blank.format(column)
    return f"coalesce((select canonical from alias_names where alias = {name}), {name})"


SCORED = r"""
, scored as (select *,
  try_cast(nullif(regexp_extract(score, '([0-9]+)[^0-9]+([0-9]+)', 1), '') as double) as home_goals,
  try_cast(nullif(regexp_extract(score, '([0-9]+)[^0-9]+([0-9]+)', 2), '') as double) as away_goals
  from raw_schedule)"""

TYPED_STATS = f"""
, typed as (select match_report, date, season, league, team, opponent, {_number.format('xg')} as xg,
  cast({_number.format('shots')} as bigint) as shots, cast({_number.format('sot')} as bigint) as sot, notes
  from raw_match_stats)"""

RESOLVED = ALIASES + f"""
, calendar as (select date, team, min(game_id) as fixture_id from (
   select game_id, date, {_canonical('home_team')} as team from raw_schedule union all
   select game_id, date, {_canonical('away_team')} from raw_schedule) t where team is not null group by date, team)
, linked as (select nullif(regexp_extract(match_report, '/matches/([^/]+)/', 1), '') as link, * from typed)
, resolved as (
  select link as fixture_id, match_report, date, season, league, team, opponent, xg, shots, sot, notes from linked
   where link in (select game_id from raw_schedule)
  union all
  select c.fixture_id, match_report, l.date, season, league, l.team, opponent, xg, shots, sot, notes
   from linked l join calendar c on l.date = c.date and {_canonical('l.team')} = c.team
   where link is null or link not in (select game_id from raw_schedule where game_id is not null))"""

MERGED = (
    f"""
, per_team as (select fixture_id, {_canonical('team')} as name,
   first(xg order by match_report nulls first, xg) filter (where xg is not null) as xg,
   cast(first(shots order by match_report nulls first, shots) filter (where shots is not null) as double) as shots,
   cast(first(sot order by match_report nulls first, sot) filter (where sot is not null) as double) as sot
  from resolved group by fixture_id, name)
, named as (select game_id as fixture_id, season, date, {_canonical('home_team')} as home_team,
   {_canonical('away_team')} as away_team, home_goals, away_goals from scored)
, merged as (select f.*, h.xg as home_xg, a.xg as away_xg, h.shots as home_shots, a.shots as away_shots,
   h.sot as home_sot, a.sot as away_sot, h.xg is null or a.xg is null as is_xg_missing
  from named f left join per_team h on h.fixture_id = f.fixture_id and h.name = f.home_team
  left join per_team a on a.fixture_id = f.fixture_id and a.name = f.away_team)"""
)

OBSERVATIONS = """
, observations as (
  select fixture_id, season, home_team as team, away_team as opponent, 1 as home, home_goals as goals from fixtures
   where home_goals is not null and away_goals is not null
  union all
  select fixture_id, season, away_team, home_team, 0, away_goals from fixtures
   where home_goals is not null and away_goals is not null)"""

LEAGUE = """
, league as (select season, avg(goals) as mean_goals, avg(case when home = 1 then goals end) as mean_home_goals,
   avg(case when home = 0 then goals end) as mean_away_goals from observations group by season)
, advantages as (select *, case when mean_away_goals > 0 then mean_home_goals / mean_away_goals else 1.25 end as home_advantage
   from league)"""

STRENGTH = """
, universe as (select season, home_team as team from fixtures where home_team is not null union
   select season, away_team from fixtures where away_team is not null)
, scored_means as (select season, team, avg(goals) as m from observations group by season, team)
, conceded_means as (select season, opponent as team, avg(goals) as m from observations group by season, opponent)
, strength as (select u.season, u.team,
    coalesce(s.m / nullif(l.mean_goals, 0), 1.0) as attack, coalesce(c.m / nullif(l.mean_goals, 0), 1.0) as defense
   from universe u left join scored_means s on s.season = u.season and s.team = u.team
   left join conceded_means c on c.season = u.season and c.team = u.team
   left join league l on l.season = u.season)"""

STATIC = f"""
, known_rows as (
  select season, date, home_team as team, 1 as home, case when home_goals + away_goals is not null then home_goals end as g,
   case when home_goals + away_goals is not null then away_goals end as c from fixtures
  union all select season, date, away_team, 0, case when home_goals + away_goals is not null then away_goals end,
   case when home_goals + away_goals is not null then home_goals end from fixtures)
, team_days as (select season, team, date, coalesce(sum(g), 0) as g, coalesce(sum(c), 0) as c, count(g) as n from known_rows group by all)
, league_days as (select season, date, coalesce(sum(g) filter (where home = 1), 0) as h, coalesce(sum(c) filter (where home = 1), 0) as a,
   count(g) filter (where home = 1) as n from known_rows group by all)
, team_before as (select season, team, date, sum(g) over w as g, sum(c) over w as c, sum(n) over w as n from team_days
   window w as (partition by season, team order by date rows between unbounded preceding and 1 preceding))
, league_before as (select season, date, sum(h) over w as h, sum(a) over w as a, sum(n) over w as n from league_days
   window w as (partition by season order by date rows between unbounded preceding and 1 preceding))
, knowing as (select f.*, case when l.a > 0 then l.h / l.a else 1.25 end as v,
   coalesce(x.g / nullif(x.n, 0) / nullif((l.h + l.a) / nullif(2 * l.n, 0), 0), 1.0) as ha,
   coalesce(x.c / nullif(x.n, 0) / nullif((l.h + l.a) / nullif(2 * l.n, 0), 0), 1.0) as hd,
   coalesce(y.g / nullif(y.n, 0) / nullif((l.h + l.a) / nullif(2 * l.n, 0), 0), 1.0) as aa,
   coalesce(y.c / nullif(y.n, 0) / nullif((l.h + l.a) / nullif(2 * l.n, 0), 0), 1.0) as ad
  from fixtures f left join league_before l on l.season = f.season and l.date = f.date
  left join team_before x on x.season = f.season and x.team = f.home_team and x.date = f.date
  left join team_before y on y.season = f.season and y.team = f.away_team and y.date = f.date)
, static as (select *, {_round('1.35 * ha * ad * sqrt(v)', 3)} as expected_home_goals,
   {_round('1.35 * aa * hd / sqrt(v)', 3)} as expected_away_goals from knowing)"""

_STATIC_ALL = STATIC

RUNS = """
, flagged as (select *, minutes_played is null or minutes_played = 0 as missed,
   coalesce(avg(minutes_played) over (partition by player_id order by date, fixture_id
    rows between 5 preceding and 1 preceding), 0) / 90.0 as starter_minute_share
  from player_logs where player_id is not null)
, islands as (select *, sum(case when missed then 0 else 1 end) over (partition by player_id order by date, fixture_id) as island
  from flagged)
, runs as (select *, cast(sum(case when missed then 1 else 0 end) over (
    partition by player_id, island order by date, fixture_id) as bigint) as consecutive_missed from islands)"""

POSITIONS = f", positions(tag, grp) as (values {_values(POSITION_GROUPS)})"
_GROUP = (
    "coalesce((select grp from positions where tag = upper("
    + _blank.format("split_part(position, ',', 1)")
    + ")), 'MID')"
)
ABSENT = f"""
, absent as (select fixture_id, date, team, player_id, player_name, {_GROUP} as position_group,
   case when consecutive_missed >= 2 then 'injury' else 'rotation_suspension' end as absence_type,
   starter_minute_share, consecutive_missed
  from runs where missed and starter_minute_share >= 0.45)"""

LOAD = """
, loads as (select fixture_id, team, sum(case position_group when 'GK' then 1.4::double when 'DEF' then (1.3::double + 1.1) / 2
   when 'MID' then 1.2::double else (1.0::double + 1.1) / 2 end * starter_minute_share * pow(0.7::double, consecutive_missed - 1)) as load
  from absent group by fixture_id, team)"""


def _adjusted(source: str) -> str:
    return f"""
, adjusted as (select f.*,
   expected_home_goals * exp(-0.05 * coalesce(h.load, 0)) as adjusted_home_goals,
   expected_away_goals * exp(-0.05 * coalesce(a.load, 0)) as adjusted_away_goals
  from {source} f left join loads h on h.fixture_id = f.fixture_id and h.team = f.home_team
  left join loads a on a.fixture_id = f.fixture_id and a.team = f.away_team)"""


def _grid(source: str, home: str, away: str, tag: str = "") -> str:
    pmf = "exp(-l) * pow(l, k) / cast(factorial(k) as double)"
    return f"""
, goals{tag}(k) as (select cast(unnest(range(0, 7)) as int))
, side_h{tag} as (select fixture_id, k, {pmf} as p from (select fixture_id, cast({home} as double) as l from {source}) s, goals{tag})
, side_a{tag} as (select fixture_id, k, {pmf} as p from (select fixture_id, cast({away} as double) as l from {source}) s, goals{tag})
, grid{tag} as (select h.fixture_id, h.k as home_goals, a.k as away_goals, h.p * a.p as probability
   from side_h{tag} h join side_a{tag} a on a.fixture_id = h.fixture_id)
, outcomes{tag} as (select fixture_id,
   sum(case when home_goals > away_goals then probability end) / nullif(sum(probability), 0) as p_home,
   sum(case when home_goals = away_goals then probability end) / nullif(sum(probability), 0) as p_draw,
   sum(case when home_goals < away_goals then probability end) / nullif(sum(probability), 0) as p_away
  from grid{tag} group by fixture_id)"""


TEAM_ROWS = """
, team_rows as (
  select fixture_id, date, home_team as team, 1 as home, home_goals as gf, away_goals as ga, home_xg as xf, away_xg as xa from fixtures
  union all
  select fixture_id, date, away_team, 0, away_goals, home_goals, away_xg, home_xg from fixtures)
, team_history as (select *,
   sum(case when gf > ga then 3.0::double when gf = ga then 1 when gf < ga then 0 end) over last5 as form_points,
   avg(gf) over last5 as form_goals_for, avg(ga) over last5 as form_goals_against,
   avg(xf) over last8 as xg_for, avg(xa) over last8 as xg_against,
   date_diff('day', lag(date) over (partition by team order by date, fixture_id), date) as rest_days
  from team_rows
  window last5 as (partition by team order by date, fixture_id rows between 5 preceding and 1 preceding),
   last8 as (partition by team order by date, fixture_id rows between 8 preceding and 1 preceding))
, both_sides as (select h.fixture_id, """ + ", ".join(
    f"{alias}.{c} as {role}_{c}"
    for role, alias in (("home", "h"), ("away", "a"))
    for c in (*FORM, "xg_for", "xg_against", "rest_days")
) + """, h.xg_for - h.xg_against as home_xg_balance, a.xg_for - a.xg_against as away_xg_balance
  from team_history h join team_history a on a.fixture_id = h.fixture_id and a.home = 0 where h.home = 1)"""

MEETINGS = """
, oriented as (select fixture_id, date, least(home_team, away_team) as lo, greatest(home_team, away_team) as hi,
   home_team < away_team as at_home,
   case when home_team < away_team then home_goals - away_goals else away_goals - home_goals end as m from fixtures)
, met as (select *, count(m) over w as n, count(case when m > 0 then 1 end) over w as lo_wins,
   count(case when m < 0 then 1 end) over w as hi_wins, coalesce(sum(m) over w, 0) as margin
  from oriented window w as (partition by lo, hi order by date, fixture_id rows between unbounded preceding and 1 preceding))
, h2h as (select fixture_id, n as h2h_matches, case when at_home then lo_wins else hi_wins end as h2h_home_wins,
   n - lo_wins - hi_wins as h2h_draws, case when at_home then hi_wins else lo_wins end as h2h_away_wins,
   case when at_home then margin else 0 - margin end as h2h_goal_diff from met)"""

ELO_AT = """
, elo_at as (select f.fixture_id, h.elo as home_elo, a.elo as away_elo, h.elo - a.elo as elo_diff
  from fixtures f asof left join elo h on h.team = f.home_team and f.date > h.date
  asof left join elo a on a.team = f.away_team and f.date > a.date)"""

MEMBERS = """
, side_rows as (select fixture_id, date, home_team as team from fixtures union all select fixture_id, date, away_team from fixtures)
, ranked as (select *, row_number() over (partition by team order by date nulls last, fixture_id) as rn from side_rows)
, members as materialized (select distinct s.fixture_id, m.fixture_id as member_id
  from (select fixture_id, team, rn - unnest(range(1, 9)) as rn from ranked) s
  join ranked m on m.team = s.team and m.rn = s.rn)"""


def _sweeps(source: str, sweeps: int, with_home: bool = True) -> str:
    """Updates of base, advantage, attack and defense as a chain of window sums, ending in ``fitted``.

    ``source`` has grp, team, opponent, home, n and g; r is the base, v the advantage.
    """
    text = f"""
, s0 as materialized (select *, 1.0::double as r, 1.0::double as v, 1.0::double as a, 1.0::double as d from {source})"""
    mu = "n * r * case when home = 1 then v else 1 end * a * d"
    rates = [("r", "", ""), *([("v", "", "filter (where home = 1)")] if with_home else [])]
    updates = [*rates, ("a", ", team", ""), ("d", ", opponent", "")] * sweeps + rates
    for i, (column, key, only) in enumerate(updates, 1):
        name = "fitted" if i == len(updates) else f"s{i}"
        text += f"""
, {name} as materialized (select * replace ({column} * coalesce(sum(g) {only} over w / nullif(sum({mu}) {only} over w, 0), 1) as {column})
   from s{i - 1} window w as (partition by grp{key}))"""
    return text


def _season_fit(group: str, sweeps: int, with_home: bool = True) -> str:
    advantage = "case when max(v) > 0 and sum(g) > 0 then max(v) else 1.25 end" if with_home else "1.0::double"
    return (
        OBSERVATIONS
        + f"""
, cells as (select {group} as grp, team, opponent, home, cast(count(*) as double) as n, sum(goals) as g
   from observations group by grp, team, opponent, home)
, everyone as (select {group} as grp, home_team as team from fixtures where home_team is not null
   union select {group}, away_team from fixtures where away_team is not null)"""
        + _sweeps("cells", sweeps, with_home)
        + f"""
, adv as (select grp, {advantage} as home_advantage from fitted group by grp)
, factors as (select e.grp, e.team,
   coalesce((select max(a) from fitted f where f.grp = e.grp and f.team = e.team), 1.0) as a,
   coalesce((select max(d) from fitted f where f.grp = e.grp and f.opponent = e.team), 1.0) as d from everyone e)
, season_fit as (select grp, team, a / avg(a) over (partition by grp) as attack, d / avg(d) over (partition by grp) as defense,
   home_advantage from factors join adv using (grp))"""
    )


# Updates after which the sweeps of the SQL stand still, to more digits than are compared.
SEASON_SWEEPS, WINDOW_SWEEPS = 60, 80


def _window_sweeps(sweeps: int) -> str:
    """Factor tables of all windows, ending in ``adv_now``, ``att_now`` and ``def_now``.

    ``window_obs`` has grp, team, opponent, home, n and g. Each pair of window and team has a number.
    """
    p = f"{PRIOR_GOALS}::double"
    text = f"""
, slots as materialized (select grp, team, cast(row_number() over () as integer) as slot
   from (select distinct grp, team from window_obs))
, base as materialized (select grp, sum(g) / sum(n) as r, sum(g) filter (where home = 1) as hg from window_obs group by grp)
, coded as materialized (select o.grp, o.home, o.n * b.r as m, o.g, x.slot as t, y.slot as o from window_obs o
   join base b on b.grp = o.grp join slots x on x.grp = o.grp and x.team = o.team
   join slots y on y.grp = o.grp and y.team = o.opponent)
, scored as materialized (select t as slot, sum(g) + {p} as goals from coded group by t)
, conceded as materialized (select o as slot, sum(g) + {p} as goals from coded group by o)
, att0 as materialized (select slot, 1.0::double as a from slots)
, def0 as materialized (select slot, 1.0::double as d from slots)"""
    for i in range(1, sweeps + 1):
        last = i == sweeps
        adv, att, dfn = ("adv_now", "att_now", "def_now") if last else (f"adv{i}", f"att{i}", f"def{i}")
        rows = f"coded c join {adv} v on v.grp = c.grp"
        lift = "case when c.home = 1 then v.v else 1 end"
        text += f"""
, {adv} as materialized (select c.grp, (any_value(b.hg) + {p}) / (sum(c.m * x.a * y.d) + {p}) as v from coded c
   join att{i - 1} x on x.slot = c.t join def{i - 1} y on y.slot = c.o join base b on b.grp = c.grp where c.home = 1 group by c.grp)
, {att} as materialized (select c.t as slot, any_value(s.goals) / (sum(c.m * {lift} * y.d) + {p}) as a from {rows}
   join def{i - 1} y on y.slot = c.o join scored s on s.slot = c.t group by c.t)
, {dfn} as materialized (select c.o as slot, any_value(s.goals) / (sum(c.m * {lift} * x.a) + {p}) as d from {rows}
   join {att} x on x.slot = c.t join conceded s on s.slot = c.o group by c.o)"""
    return text


ROLLING = (
    MEMBERS
    + """
, played as (select m.fixture_id as grp, f.home_team, f.away_team, f.home_goals, f.away_goals from members m
   join fixtures f on f.fixture_id = m.member_id where f.home_goals is not null and f.away_goals is not null)
, window_obs as (
  select grp, home_team as team, away_team as opponent, 1 as home, 1.0::double as n, home_goals as g from played
  union all select grp, away_team, home_team, 0, 1.0, away_goals from played)"""
    + _window_sweeps(WINDOW_SWEEPS)
    + f"""
, window_teams as (select distinct m.fixture_id as grp, unnest([f.home_team, f.away_team]) as team
   from members m join fixtures f on f.fixture_id = m.member_id)
, attack_of as (select s.grp, s.team, x.a from slots s join att_now x on x.slot = s.slot)
, defense_of as (select s.grp, s.team, x.d from slots s join def_now x on x.slot = s.slot)
, window_factors as (select t.grp, t.team, coalesce(a, 1.0) as a, coalesce(d, 1.0) as d from window_teams t
   left join attack_of x on x.grp = t.grp and x.team = t.team left join defense_of y on y.grp = t.grp and y.team = t.team)
, window_ratings as (select grp, team, a / avg(a) over (partition by grp) as attack, d / avg(d) over (partition by grp) as defense
   from window_factors)
, window_adv as (select o.grp, count(*) as obs, case when max(x.v) > 0 and sum(g) > 0 then max(x.v) else 1.25 end as v
   from window_obs o join adv_now x on x.grp = o.grp group by o.grp)
, rated as (select f.*,
   case when w.obs >= 4 then coalesce(h.attack, 1.0) else 1.0 end as home_attack_rating,
   case when w.obs >= 4 then coalesce(h.defense, 1.0) else 1.0 end as home_defense_rating,
   case when w.obs >= 4 then coalesce(a.attack, 1.0) else 1.0 end as away_attack_rating,
   case when w.obs >= 4 then coalesce(a.defense, 1.0) else 1.0 end as away_defense_rating,
   case when w.obs >= 4 then w.v else 1.25 end as v
  from fixtures f left join window_adv w on w.grp = f.fixture_id
  left join window_ratings h on h.grp = f.fixture_id and h.team = f.home_team
  left join window_ratings a on a.grp = f.fixture_id and a.team = f.away_team)
, rolling as (select *,
   {_round('1.35 * home_attack_rating * away_defense_rating * sqrt(v)', 3)} as expected_home_goals,
   {_round('1.35 * away_attack_rating * home_defense_rating / sqrt(v)', 3)} as expected_away_goals from rated)"""
)

_MATCH_DIFFS = "home_attack_rating - away_attack_rating as attack_diff, home_defense_rating - away_defense_rating as defense_diff"

ORACLES: dict[str, str] = {}

# --- sources ---

ORACLES["scan_fixtures"] = ctes("raw_schedule") + SCORED + """
select game_id as fixture_id, season, league, date, home_team, away_team, home_goals, away_goals from scored
where season = '2023-2024' and league = 'first'"""

ORACLES["scan_match_stats"] = ctes("raw_match_stats") + TYPED_STATS + " select * from typed where season = '2024-2025'"

ORACLES["match_stats_for_fixture"] = ctes("raw_match_stats") + TYPED_STATS + """
select '00000420' as fixture_id, * from typed where contains(match_report, '00000420')"""

ORACLES["resolve_fixture_key"] = ctes("raw_schedule", "raw_match_stats") + TYPED_STATS + RESOLVED + """
select fixture_id, team, match_report, date, notes from resolved"""

ORACLES["player_minutes"] = ctes("player_logs") + " select * from player_logs where fixture_id = '00000421'"

ORACLES["conform_player_logs"] = ctes("player_logs") + """
select fixture_id, date, team, case when player_name is not null then concat_ws('|', player_name, team) end as player_id, player_name, position, minutes_played from player_logs"""

ORACLES["elo_snapshot"] = ctes("elo") + """
select team, max(date) as date, arg_max(elo, date) as elo from elo where date <= timestamp '2024-01-20 12:00:00' group by team"""

ORACLES["elo_history"] = ctes("elo") + " select team, date, elo from elo order by team, date"

ORACLES["player_season_minutes"] = ctes("player_logs", "fixtures") + """
select f.season, p.player_id, coalesce(sum(minutes_played), 0) as minutes_played,
 count(case when minutes_played > 0 then 1 end) as appearances, count(*) as fixtures
from player_logs p left join fixtures f on f.fixture_id = p.fixture_id group by f.season, p.player_id"""

ORACLES["parquet_roundtrip"] = ctes("fixtures") + " select * from fixtures"

ORACLES["landed_season"] = ctes("fixtures") + " select * from fixtures where season = '2024-2025'"

ORACLES["landed_season_again"] = ctes("fixtures") + """
 select * replace (case when season = '2024-2025' then home_goals + 1 else home_goals end as home_goals) from fixtures"""

# --- scalar functions and projections ---

ORACLES["season_label"] = ctes("raw_schedule") + """
select game_id as fixture_id, replace(season_text, '/', '-') as label, season as label_again,
 case when season_text like '2023%' then '2023-2024' end as label_or_null from raw_schedule"""

ORACLES["parse_score"] = ctes("raw_schedule") + SCORED + r"""
, in_play as (select *, regexp_replace(score, '^\s*\([^)]*\)', '') as rest from scored)
select game_id as fixture_id, home_goals, away_goals,
 try_cast(nullif(regexp_extract(rest, '([0-9]+)[^0-9]+([0-9]+)', 1), '') as double) as home_goals_in_play,
 try_cast(nullif(regexp_extract(rest, '([0-9]+)[^0-9]+([0-9]+)', 2), '') as double) as away_goals_in_play from in_play"""

ORACLES["normalize_schedule"] = ctes("raw_schedule") + SCORED + " select game_id as fixture_id, * exclude (game_id) from scored"

ORACLES["sanitize_profile"] = ctes("raw_match_stats") + "\n" + " union all ".join(
    f"""select '{c}' as "column", count(case when not {_is_blank.format(c)} then 1 end) as non_blank,
 count({_number.format(c)}) as numeric, coalesce(bool_and(({_number.format(c)}) % 1 = 0), true) as integral from raw_match_stats"""
    for c in ("match_report", "season", "league", "team", "opponent", "xg", "shots", "sot", "notes")
)

ORACLES["sanitize_numeric"] = ctes("raw_match_stats") + TYPED_STATS + " select * from typed"

ORACLES["standardize_teams"] = ctes("raw_schedule") + ALIASES + f"""
select game_id as fixture_id, {_canonical('home_team')} as home_team, {_canonical('away_team')} as away_team, score from raw_schedule"""

ORACLES["position_group"] = ctes("player_logs") + POSITIONS + f"""
select fixture_id, player_id, {_GROUP} as position_group from player_logs"""

ORACLES["xg_missing_flag"] = ctes("fixtures") + """
select fixture_id, home_xg, away_xg, home_xg is null or away_xg is null as is_xg_missing from fixtures"""

ORACLES["base_differentials"] = ctes("fixtures") + f"""
select fixture_id, home_goals - away_goals as goals_diff, {_round('home_xg - away_xg')} as xg_diff,
 cast(null as double) as shots_diff, cast(null as double) as sot_diff from fixtures"""

_STATS_CTES = ctes("raw_schedule", "raw_match_stats") + SCORED + TYPED_STATS + RESOLVED + MERGED

ORACLES["merge_match_stats"] = _STATS_CTES + """
select fixture_id, home_team, away_team, home_xg, away_xg, home_shots, away_shots, home_sot, away_sot, is_xg_missing from merged"""

ORACLES["clean_fixtures"] = _STATS_CTES + f"""
select fixture_id, season, date, home_team, away_team, home_goals, away_goals, home_xg, away_xg, is_xg_missing,
 home_goals - away_goals as goals_diff, {_round('home_xg - away_xg')} as xg_diff, home_shots - away_shots as shots_diff,
 home_sot - away_sot as sot_diff from merged order by date, fixture_id"""

# --- profiles ---

ORACLES["validate_fixtures"] = ctes("fixtures") + """
select count(*) as rows, count(distinct fixture_id) as fixture_ids, 'away_team' as missing_columns from fixtures"""

ORACLES["missing_profile"] = ctes("fixtures") + f"""
, counts as (select 'home_goals' as "column", count(*) - count(home_goals) as rows, count(*) as total from fixtures
 union all select 'away_goals', count(*) - count(away_goals), count(*) from fixtures
 union all select 'home_xg', count(*) - count(home_xg), count(*) from fixtures
 union all select 'away_xg', count(*) - count(away_xg), count(*) from fixtures
 union all select 'is_xg_missing = true', count(case when home_xg is null or away_xg is null then 1 end), count(*) from fixtures)
select "column", rows, {_round('rows / total')} as rate from counts where rows > 0"""

ORACLES["fixture_sample"] = ctes("fixtures") + """
select fixture_id, date, home_team, away_team, home_goals from fixtures order by date, fixture_id limit 5"""

# --- absences ---

ORACLES["starter_minute_share"] = ctes("player_logs") + RUNS + f"""
select player_id, fixture_id, {_round('starter_minute_share')} as starter_minute_share from runs"""

ORACLES["consecutive_missed"] = ctes("player_logs") + RUNS + " select player_id, fixture_id, consecutive_missed from runs"

ORACLES["player_absences"] = ctes("player_logs") + RUNS + POSITIONS + ABSENT + f"""
select * exclude (consecutive_missed) replace ({_round('starter_minute_share')} as starter_minute_share) from absent"""

ORACLES["absence_type"] = ctes("player_logs") + RUNS + """
select player_id, fixture_id, consecutive_missed,
 case when consecutive_missed >= 2 then 'injury' else 'rotation_suspension' end as absence_type,
 case when consecutive_missed >= 3 then 'injury' else 'rotation_suspension' end as absence_type_from_3 from runs where missed"""

ORACLES["absence_distribution"] = ctes("player_logs") + RUNS + POSITIONS + ABSENT + """
select 'absence_type' as "column", absence_type as value, count(*) as rows from absent group by absence_type
union all select 'position_group', position_group, count(*) from absent group by position_group"""

ORACLES["absence_by_season"] = ctes("player_logs", "fixtures") + RUNS + POSITIONS + ABSENT + """
select f.season, absence_type, count(*) as absences from absent a left join fixtures f on f.fixture_id = a.fixture_id
group by f.season, absence_type"""

# --- ratings ---

ORACLES["poisson_observations"] = ctes("fixtures") + OBSERVATIONS + """
select fixture_id, team, opponent, home, goals from observations"""

ORACLES["team_universe"] = ctes("fixtures") + """
select home_team as team from fixtures where home_team is not null union select away_team from fixtures where away_team is not null"""

ORACLES["reference_team"] = ctes("fixtures") + """
select min(team) as first_team, count(*) as teams from (
 select home_team as team from fixtures union select away_team from fixtures) t where team is not null"""

ORACLES["empirical_home_advantage"] = ctes("fixtures") + OBSERVATIONS + LEAGUE + f"""
select season, {_rounded(('mean_goals', 'mean_home_goals', 'mean_away_goals', 'home_advantage'))} from advantages"""

ORACLES["empirical_ratings"] = ctes("fixtures") + OBSERVATIONS + LEAGUE + STRENGTH + f"""
select season, team, {_rounded(('attack', 'defense'))} from strength"""

ORACLES["team_last_n"] = ctes("fixtures") + """
, sides as (select home_team as team, fixture_id, date from fixtures union select away_team, fixture_id, date from fixtures)
select * from (select team, fixture_id, date,
  row_number() over (partition by team order by date desc nulls first, fixture_id desc) as recency from sides where team is not null) r
where recency <= 8"""

ORACLES["rating_window_members"] = ctes("fixtures") + MEMBERS + " select fixture_id, member_id from members"

_FACTORS = ("attack", "defense", "home_advantage")
ORACLES["poisson_ratings"] = ctes("fixtures") + _season_fit("season", SEASON_SWEEPS) + f"""
select grp as season, team, {_rounded(_FACTORS)} from season_fit"""

ORACLES["poisson_ratings_without_home"] = ctes("fixtures") + _season_fit("season", SEASON_SWEEPS, with_home=False) + f"""
select grp as season, team, {_rounded(_FACTORS)} from season_fit"""

ORACLES["poisson_ratings_glr"] = ctes("fixtures") + _season_fit("0", 60) + f"""
select team, {', '.join(f'{_round(c, 5)} as {c}' for c in _FACTORS)} from season_fit"""

ORACLES["rolling_ratings"] = ctes("fixtures") + ROLLING + f"""
select fixture_id, {_rounded(RATING_COLUMNS)}, expected_home_goals, expected_away_goals from rolling"""

ORACLES["expected_goals"] = ctes("fixtures") + _STATIC_ALL + """
select fixture_id, expected_home_goals, expected_away_goals from static"""

ORACLES["expected_goals_summary"] = ctes("fixtures") + _STATIC_ALL + f"""
, stacked as (select 'expected_home_goals' as "column", expected_home_goals as v from static
  union all select 'expected_away_goals', expected_away_goals from static)
select "column", count(v) as count, {_round('avg(v)', 9)} as mean, {_round('stddev_samp(v)', 9)} as std, min(v) as min,
 {_round('quantile_cont(v, 0.25)', 9)} as p25, {_round('quantile_cont(v, 0.5)', 9)} as p50, {_round('quantile_cont(v, 0.75)', 9)} as p75,
 max(v) as max from stacked group by "column" """

# --- features ---

ORACLES["elo_asof"] = ctes("fixtures", "elo") + ELO_AT + " select * from elo_at"

ORACLES["unmatched_teams"] = ctes("raw_schedule", "elo") + """
, ours as (select home_team as team from raw_schedule where home_team is not null union select away_team from raw_schedule where away_team is not null)
select team, 'elo' as missing_in from ours where team not in (select team from elo)
union all select distinct team, 'fixtures' from elo where team not in (select team from ours)"""

_sided = lambda names: [f"{r}_{c}" for r in ("home", "away") for c in names]
ORACLES["rolling_form"] = ctes("fixtures") + TEAM_ROWS + f"""
select fixture_id, home_form_points, away_form_points, {_rounded([c for c in _sided(FORM) if 'goals' in c])} from both_sides"""

ORACLES["rolling_xg"] = ctes("fixtures") + TEAM_ROWS + f" select fixture_id, {_rounded(_sided(XG))} from both_sides"

ORACLES["rest_days"] = ctes("fixtures") + TEAM_ROWS + " select fixture_id, home_rest_days, away_rest_days from both_sides"

ORACLES["head_to_head"] = ctes("fixtures") + MEETINGS + " select * from h2h"

ORACLES["rating_diffs"] = ctes("fixtures", "elo") + ROLLING + ELO_AT + f"""
, diffs as (select fixture_id, {_MATCH_DIFFS}, expected_home_goals - expected_away_goals as expected_goals_diff from rolling)
select d.fixture_id, {_rounded(('attack_diff', 'defense_diff', 'expected_goals_diff'))}, elo_diff
from diffs d join elo_at e on e.fixture_id = d.fixture_id"""

ORACLES["feature_table"] = (
    ctes("fixtures", "elo", "player_logs") + RUNS + POSITIONS + ABSENT + LOAD + ROLLING + _adjusted("rolling")
    + _grid("adjusted", "adjusted_home_goals", "adjusted_away_goals") + TEAM_ROWS + MEETINGS + ELO_AT
    + f"""
, own as (select fixture_id, date, {_MATCH_DIFFS}, home_xg is null or away_xg is null as is_xg_missing,
   expected_home_goals - expected_away_goals as expected_goals_diff, adjusted_home_goals, adjusted_away_goals,
   case when home_goals > away_goals then 'home' when home_goals = away_goals then 'draw' when home_goals < away_goals then 'away' end as result
  from adjusted)
select o.fixture_id, o.date, result, is_xg_missing, {_rounded(('attack_diff', 'defense_diff', 'expected_goals_diff', 'adjusted_home_goals', 'adjusted_away_goals'))},
 {_rounded(('p_home', 'p_draw', 'p_away'))}, {_rounded(_sided((*FORM, *XG)))}, home_rest_days, away_rest_days,
 h2h_matches, h2h_home_wins, h2h_draws, h2h_away_wins, {_rounded(('h2h_goal_diff', 'home_elo', 'away_elo', 'elo_diff'))}
from own o left join outcomes p on p.fixture_id = o.fixture_id left join both_sides b on b.fixture_id = o.fixture_id
left join h2h x on x.fixture_id = o.fixture_id left join elo_at e on e.fixture_id = o.fixture_id"""
)

_CORRELATED = [*_sided(FORM), *_sided(XG)]
ORACLES["feature_correlation"] = ctes("fixtures") + TEAM_ROWS + "\n" + " union all ".join(
    f"""select '{a}' as "left", '{b}' as "right", {_round(f'corr({a}, {b})')} as correlation from both_sides"""
    for a, b in combinations(_CORRELATED, 2)
)

# --- forecasts ---

_LOADS = RUNS + POSITIONS + ABSENT + LOAD
ORACLES["absence_load"] = ctes("player_logs") + _LOADS + f" select fixture_id, team, {_round('load')} as load from loads"

ORACLES["adjusted_lambda"] = ctes("fixtures", "player_logs") + _STATIC_ALL + _LOADS + _adjusted("static") + f"""
select fixture_id, expected_home_goals, {_round('adjusted_home_goals')} as adjusted_home_goals, expected_away_goals,
 {_round('adjusted_away_goals')} as adjusted_away_goals from adjusted"""

_STATIC_GRID = _STATIC_ALL + _grid("static", "expected_home_goals", "expected_away_goals")
_OUTCOMES = ("p_home", "p_draw", "p_away")
ORACLES["scoreline_grid"] = ctes("fixtures") + _STATIC_GRID + f"""
select fixture_id, home_goals, away_goals, {_round('probability', 8)} as probability from grid"""

ORACLES["outcome_probabilities"] = ctes("fixtures") + _STATIC_GRID + f" select fixture_id, {_rounded(_OUTCOMES)} from outcomes"

ORACLES["blend_probabilities"] = ctes("fixtures") + _STATIC_GRID + _grid("fixtures", "home_xg", "away_xg", "_xg") + """
, mixed as (select a.fixture_id, """ + ", ".join(f"0.5 * a.{o} + 0.5 * b.{o} as {o}" for o in _OUTCOMES) + f"""
  from outcomes a join outcomes_xg b on b.fixture_id = a.fixture_id)
select fixture_id, {', '.join(f"{_round(f'{o} / (p_home + p_draw + p_away)')} as {o}" for o in _OUTCOMES)} from mixed"""

# --- evaluation ---

ORACLES["walk_forward_folds"] = ctes("fixtures") + """
, placed as (select fixture_id, date, row_number() over (order by date nulls last, fixture_id) as position from fixtures)
, folded as (select *, cast(greatest(ceil((position - 200) / 38), 0) as bigint) as fold from placed)
select *, case when fold > 0 then cast(200 + 38 * (fold - 1) as bigint) end as train_rows from folded"""

ORACLES["brier_score"] = ctes("scores") + f"""
select lang, count((p - y) * (p - y)) as n, {_round('avg((p - y) * (p - y))')} as brier from scores group by lang"""

_SAFE = "least(greatest(p, 1e-15), 1 - 1e-15)"
_LOSS = f"-(y * ln({_SAFE}) + (1 - y) * ln(1 - {_SAFE}))"
ORACLES["log_loss"] = ctes("scores") + f"""
select lang, count({_LOSS}) as n, {_round(f'avg({_LOSS})')} as log_loss from scores group by lang"""

ORACLES["reliability_bins"] = ctes("scores") + f"""
select cast(least(floor(p * 10), 9) as bigint) as bin, count(*) as n, {_round('avg(p)')} as mean_p, {_round('avg(y)')} as observed
from scores where p is not null and y is not null group by 1"""

_hit = lambda sign: f"case when f.home_goals {sign} f.away_goals then 1.0::double else 0 end"
ORACLES["brier_trend"] = ctes("fixtures") + _grid("fixtures", "home_xg", "away_xg") + f"""
select date_trunc('week', f.date) as period, count(*) as n,
 {_round(f"avg(pow(p_home - {_hit('>')}, 2) + pow(p_draw - {_hit('=')}, 2) + pow(p_away - {_hit('<')}, 2))")} as brier
from fixtures f join outcomes o on o.fixture_id = f.fixture_id
where f.home_goals is not null and f.away_goals is not null and p_home is not null group by 1"""


def _newton(steps: int) -> str:
    text = """
, points as (select doc_id, y, ln(q / (1 - q)) as x from (select *, least(greatest(p, 1e-6), 1 - 1e-6) as q from scores) s)
, n0 as (select 0.0::double as a, 0.0::double as b)"""
    for i in range(1, steps + 1):
        text += f"""
, n{i} as materialized (select a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b
  from (select any_value(a) as a, any_value(b) as b, sum(y - m) as g0, sum((y - m) * x) as g1, sum(m * (1 - m)) as h00,
   sum(m * (1 - m) * x) as h01, sum(m * (1 - m) * x * x) as h11
   from (select y, x, a, b, 1 / (1 + exp(-(a + b * x))) as m from points, n{i - 1} where y is not null and x is not null) t) u)"""
    return text


ORACLES["platt_scaling"] = ctes("scores") + _newton(12) + f"""
select doc_id, {_round('1 / (1 + exp(-(a + b * x)))', 4)} as calibrated from points, n12"""

ORACLES["isotonic"] = ctes("scores") + f"""
, steps as (select p as x, sum(y) as s, cast(count(*) as double) as w from scores where p is not null and y is not null group by 1)
, placed as (select x, row_number() over (order by x) as i, sum(s) over (order by x) as cs, sum(w) over (order by x) as cw from steps)
, pairs as (select a.i as a, b.i as b, (b.cs - coalesce(z.cs, 0)) / (b.cw - coalesce(z.cw, 0)) as m
  from placed a join placed b on b.i >= a.i left join placed z on z.i = a.i - 1)
, least_after as (select a, b, min(m) over (partition by a order by b desc) as m from pairs)
, curve as (select b as i, max(m) as fit from least_after group by b)
select doc_id, {_round('fit')} as calibrated from scores join placed on x = p join curve using (i)"""

_OUT_OF_FOLD = ctes("scores") + f"""
, folded as (select *, doc_id % 5 as fold from scores)
, steps as (select k.k, p as x, sum(y) as s, cast(count(*) as double) as w from folded join (select unnest(range(1, 5)) as k) k on fold < k.k
   where p is not null and y is not null group by k.k, p)
, placed as (select k, x, row_number() over (partition by k order by x) as i, sum(s) over (partition by k order by x) as cs,
   sum(w) over (partition by k order by x) as cw from steps)
, pairs as (select a.k, a.i as a, b.i as b, (b.cs - coalesce(z.cs, 0)) / (b.cw - coalesce(z.cw, 0)) as m
  from placed a join placed b on b.k = a.k and b.i >= a.i left join placed z on z.k = a.k and z.i = a.i - 1)
, least_after as (select k, a, b, min(m) over (partition by k, a order by b desc) as m from pairs)
, curve as (select k, b as i, max(m) as fit from least_after group by k, b)
, heights as (select k, x, fit from placed join curve using (k, i))
, lowest as (select k, min(fit) as fit from heights group by k)
, recalibrated as (select f.*, case when p is not null then coalesce(h.fit, l.fit) end as calibrated
  from folded f asof left join heights h on h.k = f.fold and f.p >= h.x left join lowest l on l.k = f.fold)"""

ORACLES["isotonic_out_of_fold"] = _OUT_OF_FOLD + f" select doc_id, fold, {_round('calibrated')} as calibrated from recalibrated"

ORACLES["recalibration_effect"] = _OUT_OF_FOLD + f"""
select fold, count(*) as n, {_round('avg((p - y) * (p - y))')} as brier_before, {_round('avg((calibrated - y) * (calibrated - y))')} as brier_after
from recalibrated where p is not null and calibrated is not null and y is not null group by fold"""
