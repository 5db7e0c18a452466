"""Column functions (P*): built-in Spark expressions only."""

from titlelake.functions.numeric import rate, to_number, to_ts, to_view_int, with_engagement  # noqa: F401
from titlelake.functions.records import (  # noqa: F401
    classify_fetch, extract_reference, generation_prompt, hash_key, infer_id, messages_to_text,
    parse_verdict, retryable_id, review_prompt, select_source, sft_user_prompt, shard_of,
    to_messages, transcript_score, transcript_source,
)
from titlelake.functions.text import (  # noqa: F401
    ascii_letter_ratio, clean_prediction, contains_any, fmt4, has_stopword, is_english_like,
    join_snippets, normalize_title, safe_strip, title_len, word_tokens,
)
