"""Writers that turn block tables back into books and logs."""
