"""Queries that apply the operators to the tables at hand, and the SQL that they are held against."""
