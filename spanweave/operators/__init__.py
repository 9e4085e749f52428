"""Operators: DataFrame -> DataFrame and Column -> Column."""
