"""How evenly an action's shuffled bytes are dealt to tasks, as Spark counts them."""

from contextlib import contextmanager

SPLIT = {
    "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@contextmanager
def split_often(spark):
    """Skewed joins are split at sizes that a test has."""
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stages(spark):
    """(stage, bytes read from shuffles by each task) of all stages that ended."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, out = sc._jsc.sc().statusStore(), {}
    listed = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    for i in range(listed.size()):
        stage = listed.apply(i)
        if str(stage.status()) != "COMPLETE" or not stage.shuffleReadBytes():
            continue
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 100_000)
        sizes = []
        for j in range(tasks.size()):
            metrics = tasks.apply(j).taskMetrics()
            if metrics.isDefined():
                read = metrics.get().shuffleReadMetrics()
                sizes.append(read.localBytesRead() + read.remoteBytesRead())
        out[stage.stageId()] = sizes
    return out


def largest(spark, action, least_bytes):
    """The largest task's share of a stage's shuffled bytes, of the stages of `action` that read `least_bytes` or more."""
    before = set(stages(spark))
    with split_often(spark):
        action()
    found = {k: v for k, v in stages(spark).items() if k not in before and sum(v) >= least_bytes}
    assert found
    return max(max(v) / sum(v) for v in found.values())
