from courtside.operators.core import (  # noqa: F401
    band_percent_rank, current_run_length, filter_global_extreme, filter_group_extreme,
    filter_having, first_per_key, global_row_number, null_aware_rank, running_sum,
    separate, share_of_total, slice_by, top_n_with_ties, unite, unpivot,
    with_opponent_totals,
)
