"""Registered plans: each module adds queries of the library, with the SQL they must equal where SQL can say it."""
