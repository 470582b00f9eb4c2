"""Worker functions run where the package cannot be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import numpy as np
from halosift.session import local_session
from halosift.models import score, train
from halosift.models.nets import Adam, conv_net
spark = local_session("workers", 2, spark__checkpoint__dir={shared!r})
rows = [(i, i % 2, [float(i % 3), 1.0, 0.0, 2.0] + [0.5] * 12) for i in range(40)]
df = spark.createDataFrame(rows, "key int, label int, x array<double>")
net = conv_net((4, 4, 1), 2, [2])
fit = train.pin_shards(df, [0, 1], 2, ["key"])
state, seen = train.train_epoch(fit, net, Adam.begin(net.initial(1)), 1, 0)
train.evaluate(fit, net, state.params)
assert score.score(df, net, state.params).filter("size(p) = 2").count() == 40
assert score.activations(df, net, state.params, "conv0", ["key"]).count() == 40 * 8
print("workers ok")
"""


def test_workers_do_not_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, shared=str(tmp_path / "shared"))],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "workers ok" in done.stdout, done.stderr[-2000:]
