"""Every query with SQL against DuckDB, and the entry point's contract."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same
from voxelry import fixtures as fx
from voxelry.plans import catalogue, kernels


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE | kernels.ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    same((catalogue.QUERIES | kernels.QUERIES)[name](spark, sf), duck, (catalogue.ORACLE | kernels.ORACLE)[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["point_normals", "convex_hull", "meshpoints_surround", "surface_areas", "contour_regions"])
def test_kernel_queries_give_rows(spark, sf, name):
    assert kernels.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name, every", [("bridge_gaps", 5), ("simplify_path", 1)])
def test_paths_run_over_all_voxels_of_a_slice(spark, sf, name, every):
    slices = {}
    for r in fx.vox(spark, sf).collect():
        slices.setdefault(r.z, []).append((r.x, r.y))
    ends = {(z, *s[k - 1]) for z, s in slices.items() if s.sort() is None for k in (every, len(s) // every * every)}
    assert ends <= {(r.z, r.x, r.y) for r in kernels.QUERIES[name](spark, sf).collect()}
