"""Operators for preparing training text at scale, one module each.

``queries`` lists the registered queries and their SQL; nothing outside this
subpackage imports it except the driver's entry module.
"""
