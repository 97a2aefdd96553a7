from __future__ import annotations

from types import SimpleNamespace

import pytest

from concordia.sources.tables import shared_folder


def session(**conf):
    made = []
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(setCheckpointDir=made.append)), made


def test_the_named_folder_is_used():
    spark, made = session(**{"spark.checkpoint.dir": "s3a://b/x/", "spark.master": "yarn"})
    assert shared_folder(spark) == "s3a://b/x" and not made


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local[4, 2]"])
def test_one_machine_gets_a_local_folder(master):
    assert shared_folder(session(**{"spark.master": master})[0]).startswith("file:///tmp")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(session(**{"spark.master": master})[0])
