"""Operators of a training-data pipeline; nothing else in the library imports them.

Common rules, unless an operator says otherwise: a null text is an empty text,
every input row gives one result row (repeated rows and equal ids included), an
empty table gives an empty result, and where a result column has the name of an
input column (in any case) the result column stays.
"""
