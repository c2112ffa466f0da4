"""Running a stream over what there is, once, and reading back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from docflow.sources.shared import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Counting a state's keys looks each one up once more when it is written.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def drained(stream: DataFrame, mode: str = "append", timers: bool = True) -> DataFrame:
    """All that ``stream`` gives for the data there is (of mode complete: its last state).

    Without ``timers`` no batch follows the last rows. That is for streams that give nothing when the
    watermark moves, where it would only take apart the state of a checkpoint that isn't used again.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/docflow-streams/{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        last.append(epoch)

    wanted_conf = STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(timers).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted_conf}
    for k, v in wanted_conf.items():
        spark.conf.set(k, v)
    try:
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not last:
        return spark.createDataFrame([], stream.schema)
    wanted = last[-1:] if mode == "complete" else last
    return spark.read.schema(stream.schema).parquet(*[f"{path}/out/epoch={e}" for e in wanted])
