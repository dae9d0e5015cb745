"""Tables that the operators read and the report store they write."""
