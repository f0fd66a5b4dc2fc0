"""Reading and writing workbooks, stored versions, CSV and reports."""
