import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from alertweave.session import build_session, ship  # noqa: E402

ALERT = (
    "row_id bigint, decoder_name string, rule_id string, rule_level int, rule_description string, first_seen string, last_seen string, alert_ts timestamp, count bigint, "
    "entity_users array<string>, entity_ips array<string>, entity_hosts array<string>, agent_name string, source_address string, destination_address string, cluster_id int, community_id bigint"
)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "3g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def alerts(spark):
    """Builds alert rows from dicts; what is left out is null."""
    names = [f.strip().split(" ")[0] for f in ALERT.split(", ")]

    def build(*rows):
        return spark.createDataFrame([tuple(r.get(n, i + 1 if n == "row_id" else None) for n in names) for i, r in enumerate(rows)], ALERT)

    return build


@pytest.fixture(scope="session")
def zones(spark):
    from alertweave.operators.instants import zone_table

    rows = [("mad", "Europe/Madrid", "dmy"), ("nyk", "America/New_York", "mdy"), ("hub", "UTC", "ymd"), ("del", "Asia/Kolkata", "dmy"), ("syd", "Australia/Sydney", "dmy"), ("lhi", "Australia/Lord_Howe", "dmy"), ("bad", "No/Where", "dmy"), (None, "UTC", "ymd")]
    return zone_table(spark.createDataFrame(rows, "agent_name string, zone_name string, date_order string"))
