"""DataFrame-to-DataFrame operators.

Plans are lazy with three exceptions that run a job when called: tables written to the shared
folder (dictionaries, closures), the count of heavy keys before a salted join, and model fits.
"""
