"""millrace: batch analytics operators as plain DataFrame -> DataFrame functions."""
