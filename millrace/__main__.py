"""``python -m millrace ingest DOCS INDEX``, ``ask INDEX QUESTION [REPLIES]``, ``inspect INDEX``.

REPLIES is a JSON list of model replies; with it a question goes through the
agent, without it through retrieval alone.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from millrace.config import Settings
from millrace.operators.fusion import embed_queries, retrieve
from millrace.plans.agent import Agent
from millrace.plans.answer import answer_safely
from millrace.plans.providers import ScriptedChat
from millrace.registry import importable
from millrace.sources import index_store


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("ingest", "ask", "inspect"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    importable(spark)
    if args[0] == "ingest":
        print(json.dumps(index_store.ingest(spark, args[1], args[2])))
    elif args[0] == "inspect":
        index_store.figures(spark, args[1]).show(truncate=False)
        index_store.inspect(spark, args[1]).show(100, truncate=False)
    else:
        index = index_store.load(spark, args[1], settings=Settings())
        if len(args) > 3:
            with open(args[3], encoding="utf-8") as f:
                chat = ScriptedChat(json.load(f))
            result = Agent(spark, index, chat).run(args[2])
            print(answer_safely(spark, chat, args[2], result.context))
            for step in result.trace:
                print(step)
            print(json.dumps(result.stats))
        else:
            asked = spark.createDataFrame([(0, args[2])], "query_id long, text string")
            retrieve(index, embed_queries(asked, index.dim, index.embed)).orderBy("rank").show(truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
