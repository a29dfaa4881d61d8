"""Explicit schemas of all tables, and the session settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

BARS = "permno long, date date, open double, high double, low double, close double, volume double, ret double, shrout double"
MARKET = "date date, mkt double"
CANDIDATES = "canonical_id string, measure string, salience double, coverage boolean, as_of date, attention double, has_options boolean, implied_move double, iv_rank double, components map<string,double>"
SEEDS = "canonical_id string, weight double, slug string"
EDGES = "src long, dst long, kind string, weight double, directed boolean, as_of date, provenance string, vintage int, fiscal_year int, source_span string, lag_estimated boolean"
PAGES = "slug string, namespace string, version long, title string, body string, kind string, tags array<string>, source string, created_at timestamp, updated_at timestamp"
LINKS = "from_slug string, to_slug string, namespace string, created_at timestamp"
SESSION_EVENTS = (
    "event string, session_id string, timestamp timestamp, turn long, as_of date, flag_id string, a_final_ids array<string>, "
    "candidates array<struct<canonical_id:string,salience:double,iv_rank:double,implied_move:double,measure:string,coverage:boolean>>, "
    "flags array<struct<canonical_id:string,salience:double,on_entity_frontier:boolean,on_thesis_frontier:boolean,reason:string,entity_path:array<string>>>"
)
FLAG_ITEMS = "session_id string, rank int, canonical_id string, salience double, on_entity_frontier boolean, on_thesis_frontier boolean, entity_path array<string>, reason string"
TEARSHEETS = "session_id string, canonical_id string, company string, description string, prev_close double, change double, change_pct double"
HEADLINES = "session_id string, canonical_id string, rank int, title string, url string, published_at timestamp"
REST_BARS = "ticker string, results array<struct<t:long,o:double,h:double,l:double,c:double,v:double>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Session defaults: UTC days, ANSI errors, and plans that adapt to what the data turn out to be."""
    return builder.config(
        map={"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    )
