from riskset.functions.columns import (  # noqa: F401
    blank_missing,
    cap_upper,
    factor_code,
    flag_any,
    flag_threshold,
    format_estimate,
    format_interval,
    format_p_fixed,
    format_p_floor,
    lump_other,
    normalise_text,
    number_text,
    recode_binary,
    recode_map,
    round_even,
    round_n,
    significance_symbol,
    strip_parenthesised,
    text_to_number,
    to_numeric,
    weighted_index,
)
