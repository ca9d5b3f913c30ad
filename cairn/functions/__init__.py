"""Scalar functions beyond those that Spark has by the same name."""

from .scalar import all_of, dates_from_epoch, extract_year, in_list, int_divide, like, llm, near_equal, not_like, register, register_function, scalar_function, sub_string

__all__ = [
    "all_of", "dates_from_epoch", "extract_year", "in_list", "int_divide", "like", "llm", "near_equal", "not_like", "register", "register_function",
    "scalar_function", "sub_string",
]
