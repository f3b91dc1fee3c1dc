"""formspark: form-record processing and analytics as plain DataFrame and Column functions."""

__version__ = "0.1.0"
