from courtside.functions.exprs import (  # noqa: F401
    ascii_fold, clock_minutes, date_from_weekday_text, last_word, lookup,
    money_to_double, ordinal, record_text, recode, replace_first, safe_ratio,
    start_minute, true_shooting,
)
