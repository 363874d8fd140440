import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"

EV_SCHEMA = ("session_id long, event_id long, t_us long, event_type string, value double, "
             "probability double, speech_duration double")


@pytest.fixture(scope="session")
def spark():
    from parley.session import local_session

    s = local_session("*", shuffle_partitions=8, app="parley-tests")
    yield s


def ev_rows(spark, rows):
    """rows: (session_id, event_id, t_us, event_type[, value]) -> EV table."""
    out = []
    for r in rows:
        sid, eid, t, et = r[:4]
        v = r[4] if len(r) > 4 else 10.0
        out.append((sid, eid, t, et, v, min(v / 100.0, 1.0), v / 100.0))
    return spark.createDataFrame(out, EV_SCHEMA)
