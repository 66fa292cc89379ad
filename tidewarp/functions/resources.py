"""What a session's tasks have to work with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def task_resources(spark: SparkSession) -> dict[str, object]:
    """Processors of a task and of an executor, tasks that run at once on it and in all, memory of an executor, and accelerators by name, of which no model here makes use.

    What a session doesn't state is None; a local session is one executor with all of its threads.
    """
    conf = spark.sparkContext.getConf()
    per_task = int(conf.get("spark.task.cpus", "1"))
    together = spark.sparkContext.defaultParallelism
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    stated = conf.get("spark.executor.cores", None)
    cores = together if local else int(stated) if stated else None
    return {
        "task_cpus": per_task,
        "executor_cores": cores,
        "executor_tasks": None if cores is None else max(1, cores // per_task),
        "tasks_at_once": max(1, together // per_task),
        "executor_memory": conf.get("spark.driver.memory" if local else "spark.executor.memory", None),
        "accelerators": {name: len(found.addresses) for name, found in sorted(dict(spark.sparkContext.resources).items())},
    }
