"""CSS selectors: parsing and matching in trees."""

from pagequarry.css.matcher import matches, select, select_first
from pagequarry.css.parser import Selector, SelectorError, parse

__all__ = ["Selector", "SelectorError", "matches", "parse", "select", "select_first"]
