"""chatlake: chat-history analytics as Spark DataFrame functions.

Tables (see ``chatlake.schemas``): conversations, messages, daily_stats,
insights, conversation_summaries, conversation_embeddings, plus the
text-free export variants.  Every operator is a function
``DataFrame(s) + parameters -> DataFrame``; nothing is collected.
"""

from chatlake.dataset import ChatData

__all__ = ["ChatData"]
