import math
import os
import random
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# An invented survey of bee colonies: one row per colony, and counts of spores per strain.
KEY = "Colony No."
COLONY_COLUMNS = ["", KEY, "weight kg", "region", "wintered", "trap, low", "trap, high", "visits", "yield"]
COLONIES = 14
STRAIN_ZEROS = {"s1": 1, "s2": 2, "s3": 3, "s4": 4, "s5": 5, "s6": 6, "s7": 7, "s8": 8, "s9": 9, "s10": 11, "s11": 12, "s12": 13}
STRAINS = list(STRAIN_ZEROS)


def _colonies():
    draw = random.Random(77)
    rows = []
    for k in range(COLONIES):
        low = round(draw.uniform(11, 24), 1)
        high = round(low + draw.uniform(0.5, 9), 1)
        weight, visits = round(draw.gauss(32, 6), 2), draw.randrange(3, 90)
        rows.append((k, 31 + 2 * k, weight, int(k % 5 < 3), k // 3 % 2, low, high, visits, round(draw.lognormvariate(2, 0.6), 1)))
    return rows


def _spores():
    """Strain j is zero in exactly its number of colonies, since 5 and 14 share no factor."""
    draw = random.Random(78)
    return [
        (
            (31 + 2 * k) * 1000,
            *[
                0.0 if (5 * k + 3 * j) % COLONIES < zeros else round(math.exp(draw.gauss(1.5 + j / 6, 0.7)), 2)
                for j, zeros in enumerate(STRAIN_ZEROS.values())
            ],
        )
        for k in range(COLONIES)
    ]


COLONY_ROWS, SPORE_ROWS = _colonies(), _spores()
COLONY_IDS = [r[1] for r in COLONY_ROWS]


@pytest.fixture(scope="session")
def fixture_files(tmp_path_factory):
    """The invented survey as two CSV files."""
    folder = tmp_path_factory.mktemp("survey")
    quoted = [f'"{c}"' if "," in c else c for c in COLONY_COLUMNS]
    colonies = [",".join(quoted)] + [",".join(map(str, r)) for r in COLONY_ROWS]
    spores = [",".join([KEY, *STRAINS])] + [",".join(map(str, r)) for r in SPORE_ROWS]
    (folder / "colonies.csv").write_text("\n".join(colonies) + "\n")
    (folder / "spores.csv").write_text("\n".join(spores) + "\n")
    return str(folder / "colonies.csv"), str(folder / "spores.csv")


@pytest.fixture(scope="session")
def cohort(spark, fixture_files):
    from twinloom.sources.tables import load_cohort

    return load_cohort(spark, *fixture_files, key=KEY)
