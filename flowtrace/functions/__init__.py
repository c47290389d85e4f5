from flowtrace.functions.exprs import (cut, hash_fraction, hash_order, history_flag, history_flags,
                                       key_text, log1p_cols, text_unset_to_zero, unset_to_zero)

__all__ = ["cut", "hash_fraction", "hash_order", "history_flag", "history_flags", "key_text",
           "log1p_cols", "text_unset_to_zero", "unset_to_zero"]
