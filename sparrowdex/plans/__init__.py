"""Plans over the corpus tables and the SQL that states what they must return."""
