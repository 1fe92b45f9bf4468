"""Reading and writing: tables, codebooks, results, and the public census tasks."""
