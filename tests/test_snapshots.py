import gzip
import hashlib

import numpy as np
import pytest

from meshflock.sources.generators import FAMILIES, MORE_FAMILIES, resized
from meshflock.sources.snapshots import restore


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_restore(spark, tmp_path):
    raw = b"1,2\n3,4\n"
    packed = gzip.compress(raw)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv.gz").write_bytes(packed)
    good = {"name": "a.csv.gz", "target": "d/a.csv", "sha256": sha(packed), "raw_sha256": sha(raw), "bytes": len(raw)}
    for bad in ({"raw_sha256": sha(b"")}, {"bytes": 3}, {"sha256": sha(b"x")}, {"target": "../a.csv"}):
        with pytest.raises(ValueError):
            restore(spark, str(tmp_path / "in"), str(tmp_path / "out"), [good, good | {"target": "b.csv"} | bad])
    assert not (tmp_path / "out").exists()
    there = (spark, str(tmp_path / "in"), str(tmp_path / "out"), [good])
    restore(*there, verify_only=True)
    assert not (tmp_path / "out").exists()
    for _ in range(2):  # what is there already stays
        (path,) = restore(*there)
        assert open(path, "rb").read() == raw
    with open(path, "ab") as f:
        f.write(b"5,6")
    for only in (True, False):
        with pytest.raises(FileExistsError):
            restore(*there, verify_only=only)


@pytest.mark.parametrize("family", sorted(FAMILIES | MORE_FAMILIES))
def test_families(family):
    x, k = (FAMILIES | MORE_FAMILIES)[family](7)
    assert len(x) == len(k) and np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)
    assert (x == (FAMILIES | MORE_FAMILIES)[family](7)[0]).all()
    assert resized(x, 50, 1).shape == (50, 2) and resized(x, 2500, 1).shape == (2500, 2)
