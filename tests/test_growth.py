"""The queries of the part mesh on two sizes: what goes through the driver does not grow, and cubes are spread before they are cut."""

import pytest

from stepfield.checks import QUERIES, base
from test_sizes import write

DRIVER = ["f01_site_wise", "f03_for_entries", "f05_probe_filter", "a02_integrate", "a02_integrate_periodic", "a03_average", "a04_averages", "a06_max_angle",
          "a07_norms", "a11_mesh_info", "a12_edge_stats", "a15_check_mesh", "a15_listed_surfaces", "a16_equalize_periodic", "p19_entrywise", "p20_by_site",
          "p22_split_parts", "p28_defined_regions", "s06_append_snapshots", "s06_save_index", "s06_units", "s07_read_snapshot"]
TASKS = ["p23_surface_only", "j06_interfaces", "s11_read_mesh_store", "p14_where_region", "p24_outer_skin", "w11_skin_layers", "j22_external_edges",
         "j26_subfield_jumps", "h09_solid_angle", "a01_site_volumes", "a19_solid_angles", "p29_fix_orientation"]


def broadcasts(node):
    """Rows of each broadcast of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from broadcasts(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from broadcasts(node.plan())
    elif kind == "BroadcastExchangeExec":
        yield node.metrics().apply("numOutputRows").value()
    children = node.children()
    for i in range(children.size()):
        yield from broadcasts(children.apply(i))


@pytest.fixture(scope="module")
def sizes(spark, tmp_path_factory):
    made = [write(spark, tmp_path_factory.mktemp(f"parts{n}"), n, n // 10) for n in (200, 800)]
    for sf in made:
        spark.createDataFrame([(k, f"NATION_{k}", k % 5) for k in range(10)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{sf}/nation.parquet")
    return made


@pytest.mark.parametrize("name", DRIVER)
def test_broadcasts_do_not_grow(spark, sizes, name):
    sent, rows = [], []
    for sf in sizes:
        df = QUERIES[name](spark, sf)
        rows.append(len(df.collect()))
        sent.append(sorted(broadcasts(df._jdf.queryExecution().executedPlan())))
    # Catalogs, saves and one row per mesh: four meshes, three subfields, four saves.
    assert min(rows) > 0 and sent[0] == sent[1] and max([0, *sent[1]]) <= 48


@pytest.mark.parametrize("name", TASKS)
def test_cubes_of_a_query_are_spread(spark, sizes, name, monkeypatch):
    made, spread = [], base.spread
    monkeypatch.setattr(base, "CUBES", 100)
    monkeypatch.setattr(base, "spread", lambda cubes, rows: made.append((rows, spread(cubes, rows))) or made[-1][1])
    assert QUERIES[name](spark, sizes[1]).count() > 0
    assert made and all(rows == 800 and df.rdd.getNumPartitions() == 8 for rows, df in made)
