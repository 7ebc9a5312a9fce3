"""From chosen items to messages, outcomes and the new ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sent_hash
from ..functions.layout import posts
from ..operators.checkpoints import cut
from ..operators.ledger import first_unsent, send_loop, upserted
from .options import Options


def delivered(chosen: DataFrame, ledger: DataFrame, now: Column, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """The outcomes (ord, use_photo, message, outcome) of chosen items with summaries, and the ledger after them.

    `send_ok` says which sends come through; a sink that posts messages sets it. In single mode the best-placed unsent item alone is tried.
    """
    keyed = chosen.withColumn("hash", sent_hash(F.col("title"), F.col("link")))
    tried = keyed.join(first_unsent(keyed, ledger, now, o.ttl_hours).select("ord"), "ord", "left_semi") if o.mode == "single" else keyed
    outcomes = cut(send_loop(tried.select("ord", "hash", "link", "send_ok"), ledger, now, o.limit, o.ttl_hours).select("ord", "outcome"))
    made = posts(tried, o.posting_policy, o.caption_sentences).join(outcomes, "ord")
    sent = keyed.join(outcomes.filter("outcome = 'sent'"), "ord").select("hash", "title", "link", "category", F.col("source_name").alias("source"), now.alias("sent_at"))
    return made.select("ord", "use_photo", "message", "outcome"), upserted(ledger, sent)
