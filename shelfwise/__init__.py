"""shelfwise: promotion and price intelligence as Spark DataFrame operators.

Every operator is a plain function from DataFrames and an explicit ``as_of``
instant to a DataFrame; nothing here calls an action on the caller's behalf
unless its docstring says so.
"""

__version__ = "0.1.0"
