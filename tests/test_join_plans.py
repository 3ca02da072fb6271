"""Rows that an explode or a Python step multiplied are not broadcast: the planner's estimate does not see how many they are."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Query and the broadcasts that it may have: mesh_skin's of its two bones.
ALLOWED = {
    "mesh_mass": 0, "mesh_inertia": 0, "mesh_splats": 0, "mesh_rays": 0, "mesh_voxels": 0, "mesh_surface_voxels": 0, "mesh_half_edges": 0, "mesh_check": 0, "mesh_skin": 1, "mesh_overlaps": 0,
    "mesh_clip_counts": 0, "mesh_clip_volumes": 0, "mesh_union": 0, "mesh_collisions": 0, "mesh_points_inside": 0, "unused_imports": 0,
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ALLOWED)
def test_no_broadcast_of_multiplied_rows(spark, name):
    plan = entry.all_queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Broadcast") <= ALLOWED[name]
