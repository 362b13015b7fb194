"""Type tests on VARIANT expressions: JSON types matter, casts would hide them."""


def kind(value: str) -> str:
    """SQL name of the JSON type: 'STRING', 'VOID' for null; NULL when absent."""
    return f"schema_of_variant({value})"


def text(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def elements(value: str) -> str:
    """The list's elements, NULL for anything but a list."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def is_string(value: str) -> str:
    return f"{kind(value)} <=> 'STRING'"


def is_optional_string(value: str) -> str:
    return f"coalesce({kind(value)} IN ('STRING', 'VOID'), TRUE)"


def is_object(value: str, path: str = "$") -> str:
    """Tested by a cast to the empty struct, which does not walk the members."""
    return f"try_variant_get({value}, '{path}', 'struct<>') IS NOT NULL"


def is_optional_object(value: str, path: str = "$") -> str:
    member = f"try_variant_get({value}, '{path}', 'variant')"
    return f"({member} IS NULL OR is_variant_null({member}) OR {is_object(value, path)})"


def is_string_list(value: str) -> str:
    """A list that holds only strings; an absent value counts as the empty list."""
    only_text = f"forall({elements(value)}, item -> {is_string('item')})"
    return f"({value} IS NULL OR coalesce({only_text}, FALSE))"
