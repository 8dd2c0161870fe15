"""What a DataFrame shuffles."""


def shuffled(spark, made):
    """Records and bytes written to shuffles while ``made()`` runs."""
    sc = spark.sparkContext
    store, bus, none = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        stages = [stages.apply(k) for k in range(stages.size())]
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in stages}

    before = total()
    made()
    new = [x for k, x in total().items() if k not in before]
    return sum(r for r, _ in new), sum(b for _, b in new)
