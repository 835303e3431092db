"""Sports tables derived from the given tables, as SQL that both engines run (but for ``unnest``)."""
from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.operators.clean import with_dates

RAW_NAMES = [
    "Man United", " Man City ", "Newcastle Utd", "Nott''m Forest", "Tottenham ", "West Ham", "Wolves",
    "Leicester", " Ipswich", "Brighton", "West Brom", "Sheffield Utd", "Luton", "Leeds", "Arsenal",
    "Chelsea", "  Liverpool", "Everton", "Fulham", "Unknown FC ",
]


def _raw_name(index: str) -> str:
    return f"split_part('{'|'.join(RAW_NAMES)}', '|', cast({index} as int) + 1)"


_SEASON = "case when ts < timestamp '2024-01-16 00:00:00' then '2023{0}2024' else '2024{0}2025' end"
_ID = "lpad(cast(event_id as string), 8, '0')"
_HOME, _AWAY = "user_id % 20", "(user_id % 20 + 1 + event_id % 19) % 20"

SQL: dict[str, str] = {
    "fixtures": f"""
select {_ID} as fixture_id, ts as date, {_SEASON.format('-')} as season, 'first' as league,
 concat('T', lpad(cast({_HOME} as string), 2, '0')) as home_team,
 concat('T', lpad(cast({_AWAY} as string), 2, '0')) as away_team,
 case when event_id % 29 = 0 then null else cast(floor(value / 20) % 6 as double) end as home_goals,
 case when event_id % 29 = 0 then null else cast((event_id * 7) % 5 as double) end as away_goals,
 case when event_id % 11 = 0 then null else cast(floor(value) as double) / cast(40 as double) end as home_xg,
 case when event_id % 13 = 0 then null else cast(event_id % 37 as double) / cast(12 as double) end as away_xg
from events""",
    "player_logs": f"""
select {_ID} as fixture_id, ts as date,
 concat('T', lpad(cast({_HOME} as string), 2, '0')) as team, cast(user_id as string) as player_id,
 concat('P', cast(user_id as string)) as player_name,
 case user_id % 5 when 0 then 'GK' when 1 then 'DF,MF' when 2 then ' fw ,MF' when 3 then 'LWB' else null end as position,
 case event_type when 'error' then cast(0 as double) when 'signup' then cast(null as double)
  else least(cast(90 as double), cast(floor(value) as double)) end as minutes_played
from events""",
    "raw_schedule": f"""
select {_ID} as game_id, ts as date, {_SEASON.format('/')} as season_text, {_SEASON.format('-')} as season,
 'first' as league,
 case when event_id % 97 = 0 then null else {_raw_name(_HOME)} end as home_team,
 {_raw_name(_AWAY)} as away_team,
 case when event_id % 29 = 0 then null when event_id % 31 = 0 then 'Postponed'
  when event_id % 37 = 0 then concat('(4) ', cast(user_id % 6 as string), '–', cast(event_id % 5 as string), ' (3)')
  else concat(cast(user_id % 6 as string), '–', cast(event_id % 5 as string)) end as score
from events""",
    "raw_match_stats": f"""
select case when event_id % 17 = 0 then null else concat('/matches/', {_ID}, '/', part) end as match_report,
 ts as date, {_SEASON.format('-')} as season, 'first' as league,
 case when side = 0 then {_raw_name(_HOME)} else {_raw_name(_AWAY)} end as team,
 case when side = 0 then {_raw_name(_AWAY)} else {_raw_name(_HOME)} end as opponent,
 case when (event_id + side) % 7 = 0 and part = 'a' then ' ' when event_id % 53 = 0 then 'n/a'
  else concat(cast(event_id % 4 as string), '.', lpad(cast(user_id % 100 as string), 2, '0')) end as xg,
 case when (event_id + side) % 19 = 0 then '' else cast(event_id % 23 + side as string) end as shots,
 case when (event_id + side) % 23 = 0 then null else concat(' ', cast(event_id % 9 + side as string), ' ') end as sot,
 case when event_id % 3 = 0 then 'Fine' when event_id % 3 = 1 then '12' else '' end as notes
from (select *, k % 2 as side, case when k < 2 then 'a' else 'b' end as part
 from (select *, unnest([0, 1, 2, 3]) as k from events) x) y
where part = 'a' or event_id % 10 = 0""",
    "elo": """
select team, day as date, cast(1500 as double) + cast(count(*) as double) as elo
from (select concat('T', lpad(cast(user_id % 20 as string), 2, '0')) as team,
  cast(cast(ts as date) as timestamp) as day from events) e
group by team, day""",
    "scores": """
select l.doc_id, d.source, d.lang, cast(l.quality as double) as y,
 cast(d.n_chars as double) / (cast(d.n_chars as double) + cast(500 as double)) as p
from labels l join documents d on l.doc_id = d.doc_id""",
}

_SOURCES = {"scores": ("labels", "documents")}


def table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table as a lazy plan over the Parquet files of ``sf_dir``."""
    sources = _SOURCES.get(name, ("events",))
    text = SQL[name].replace("unnest([0, 1, 2, 3])", "explode(array(0, 1, 2, 3))")
    for s in sources:
        text = text.replace(f"from {s}", f"from {{{s}}}").replace(f"join {s} ", f"join {{{s}}} ")
    frames = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in sources}
    df = spark.sql(text, **frames)
    return with_dates(df) if "date" in df.columns else df


def ctes(*names: str) -> str:
    """``with`` list that defines the derived tables for the checking SQL."""
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in names)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Columns rounded half to even; sums in another order differ in the last bits."""
    return df.withColumns({c: F.bround(c, places) for c in columns})
