from tessera.session import checkpoint_root, scratch_path


def test_scratch_paths_share_one_root(spark):
    root = checkpoint_root(spark)
    paths = {scratch_path(spark, "x") for _ in range(50)}
    assert checkpoint_root(spark) == root and len(paths) == 50
    assert {p.rsplit("/", 1)[0] for p in paths} == {root.rstrip("/")}
