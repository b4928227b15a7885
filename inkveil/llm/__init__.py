"""Operators for preparing training corpora: ten corpus-scale jobs and their queries.

Nothing else in the library imports this subpackage.
"""
