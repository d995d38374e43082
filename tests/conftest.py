import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ZONES = ("coast", "hill", "valley")
RIVERS = ("Aare", "Birs", "Drau", "Enns")


def sample_csv() -> str:
    """26 gauging stations by rule: the last two rows repeat the first two, ``gauge`` is sparse,
    ``zone`` and ``river`` have few values, height, rain and grade rise together."""
    lines = ["station,height,rain,zone,wind,grade,river,gauge"]
    for k in [*range(24), 0, 1]:
        height = 120 + 37 * k + (k * k) % 11
        cells = (
            f"st-{k:02d}", height, 400 + height // 2 + 13 * (k % 3), ZONES[k * k % 3 if k % 4 else 2], (7 * k) % 19,
            round(5 + 0.1 * k + 0.3 * (k % 5), 1), RIVERS[(k // 2) % 4], "" if k % 5 in (1, 4) else 60 + (k * 11) % 30,
        )
        lines.append(",".join(map(str, cells)))
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="session")
def spark():
    from tabscope.session import local_session

    s = local_session("*", shuffle_partitions=8, app="tabscope-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("sample") / "golden_sample.csv"
    p.write_text(sample_csv())
    return str(p)


@pytest.fixture(scope="session")
def sample(spark, sample_path):
    from tabscope.sources.readers import read_csv

    return read_csv(spark, sample_path)


@pytest.fixture(scope="session")
def sample_profile(sample):
    from tabscope.plans.profile import TableProfile

    return TableProfile(sample)
