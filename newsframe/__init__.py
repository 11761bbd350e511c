"""newsframe: DataFrame operators over document streams."""
