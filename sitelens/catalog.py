"""Table contracts: columns, types, descriptions, metrics and relationships."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import types as T

# Table and column names of the warehouse contracts, with Spark
# types. Clock times are strings; 0/1 flags are ints so that they can be summed.
CONTRACTS: dict[str, dict] = {
    "session": {
        "description": "Sessions with their visitor, traffic source and totals, a row each",
        "partition_by": "visit_start_date",
        "cluster_by": ["property_id", "source", "medium", "campaign"],
        "primary_key": ["session_id"],
        "ddl": """
            session_id string, visitor_id string, user_id string, visit_start_time bigint,
            visit_start_time2 string, visit_start_date date, visit_start_datetime timestamp_ntz,
            property_id string, brand string, market_code string, GA_client_id string,
            session_number bigint, visit_id bigint, source string, medium string, campaign string,
            ad_content string, keyword string, referrer string, browser string,
            device_category string, language string, bounced_session int, got_interaction_event int,
            returning_visitor int, total_hits bigint, total_page_views bigint,
            time_on_site_seconds bigint, event_start_date date, channel_grouping string
        """,
    },
    "hit": {
        "description": "Page views and events of every session, a row each",
        "partition_by": "visit_start_date",
        "cluster_by": ["session_id"],
        "primary_key": ["hit_id"],
        "ddl": """
            hit_id string, hit_type string, session_id string, hit_number bigint, visitor_id string,
            user_id string, visit_start_time bigint, visit_start_time2 string, visit_start_date date,
            visit_start_datetime timestamp_ntz, hit_datetime timestamp_ntz, hit_time string,
            property_id string, brand string, market_code string, time bigint, entrance int, exit int,
            interaction int, referrer string, page_path string, host_name string, page_title string,
            event_name string, event_category string, event_action string, event_label string,
            event_value bigint, geo_continent string, geo_country string, geo_city string,
            geo_metro string, geo_region string, content_group_1 string, content_group_2 string,
            content_group_3 string, content_group_4 string, content_group_5 string,
            previous_content_group_1 string, previous_content_group_2 string,
            previous_content_group_3 string, previous_content_group_4 string,
            previous_content_group_5 string, event_start_date date
        """,
    },
    "visitor_day": {
        "description": "Totals and flags of a visitor on a day",
        "partition_by": "visit_start_date",
        "cluster_by": [],
        "primary_key": ["visitor_day_id"],
        "ddl": """
            visitor_day_id string, visitor_id string, day_id int, visit_start_date date, brand string,
            market_code string, GA_client_id string, total_sessions bigint, total_hits bigint,
            total_page_views bigint, time_on_site_seconds bigint, engaged_visitor int,
            enquiry_visitor int, event_start_date date
        """,
    },
    "agg_visitor_month_interaction": {
        "description": "Engaged visitors of a month by brand, market and interaction",
        "partition_by": "month_id_date",
        "cluster_by": [],
        "primary_key": ["brand", "market_code", "month_id_date", "interaction_id"],
        "ddl": """
            brand string, market_code string, market_name string, region string, month_id int,
            month_id_date date, completed_month int, interaction_id int, interaction_desc string,
            total_visitors bigint
        """,
    },
    "hit_interaction_nameplate": {
        "description": "Interactions fired by hits, for each nameplate concerned",
        "partition_by": "visit_start_date",
        "cluster_by": [],
        "primary_key": ["hit_id", "interaction_id", "nameplate_code"],
        "ddl": """
            hit_interaction_nameplate_id string, hit_id string, session_id string, hit_number bigint,
            interaction_id int, nameplate_code string, visitor_id string, visit_start_time bigint,
            visit_start_date date, property_id string, brand string, market_code string,
            event_start_date date
        """,
    },
}

METRICS = {
    "enquired_visitors": {"description": "Visitors with an enquiry interaction"},
    "engaged_visitors": {"description": "Visitors with an engagement interaction"},
    "uev_enq": {"description": "Enquired visitors as a percentage of engaged visitors"},
    "config_start": {"description": "Visitors who started a configuration"},
    "config_completions": {"description": "Visitors who completed a configuration"},
}

RELATIONSHIPS = [
    {"from": "session", "to": "hit", "on": ["session_id"], "type": "one-to-many"},
    {"from": "hit", "to": "hit_interaction_nameplate", "on": ["hit_id"], "type": "one-to-many"},
    {"from": "session", "to": "hit_interaction_nameplate", "on": ["session_id"], "type": "one-to-many"},
    {"from": "session", "to": "visitor_day", "on": ["visitor_id", "visit_start_date"], "type": "many-to-one"},
    {
        "from": "hit_interaction_nameplate",
        "to": "agg_visitor_month_interaction",
        "on": ["brand", "market_code", "month", "interaction_id"],
        "type": "many-to-one",
    },
]


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def contract(table: str) -> T.StructType:
    """The table's schema."""
    columns = [c.split() for c in CONTRACTS[table]["ddl"].split(",")]
    key = CONTRACTS[table]["primary_key"]
    return T.StructType([T.StructField(name, _TYPES[kind], name not in key) for name, kind in columns])


def default_schema() -> dict:
    """The catalog as a dictionary of tables, metrics and relationships."""
    tables = {
        name: {
            "description": info["description"],
            "columns": {f.name: {"type": f.dataType.simpleString()} for f in contract(name).fields},
        }
        for name, info in CONTRACTS.items()
    }
    return {"tables": tables, "metrics": METRICS, "relationships": RELATIONSHIPS}


def load_schema(text: str | None = None) -> Mapping:
    """A catalog given as JSON text; nothing or invalid JSON gives the default."""
    if not text:
        return default_schema()
    try:
        schema = json.loads(text)
    except json.JSONDecodeError:
        return default_schema()
    return schema if "tables" in schema else {"tables": schema}
